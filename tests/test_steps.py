"""Steps of agents: texts, thoughts, calls, and reports on agents at work."""

from lumenloom.operators import transcripts as E


def test_steps(spark):
    call = lambda *names: [(n, f"{n}-id", "{}") for n in names]
    turns = [
        (None, None, call("Read")), (None, "first", call("Agent")), (None, "waiting for agents", []), ("hm", "ABC-1 created, 1/3 done", call("Bash")), ("so", None, call("Bash")), (None, "agents are running", []),
        ("x", "second", []), (None, "agent is still processing", []), ("tail", None, []),
    ]
    rows = [("s", k, "assistant", text, thinking, tools, None, None) for k, (thinking, text, tools) in enumerate(turns)]
    schema = "s string, n int, type string, text string, thinking string, tools array<struct<name:string,id:string,input_json:string>>, parent_tool_use_id string, timestamp string"
    got = [(r["n"], r["kind"], r["step"]) for r in E.agent_steps(spark.createDataFrame(rows, schema), ["s"], "n").orderBy("n", "pos").collect()]
    assert got == [
        (0, "calls", 0), (1, "text", 1), (1, "calls", 1), (2, "text", 1), (3, "thinking", 1), (3, "text", 1), (3, "calls", 1), (4, "thinking", 2), (4, "calls", 2), (5, "text", 3),
        (6, "thinking", 4), (6, "text", 4), (7, "text", 5), (8, "thinking", 5),
    ]
