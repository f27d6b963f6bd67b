"""Queries of the general problems (p2, p4, p5, p6) over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.operators import drift, hierarchy, shred
from lumenloom.session import table
from lumenloom.streaming import dedup


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surplus deliveries of agent messages and chat messages."""
    rows = dedup.deliveries(table(spark, sf_dir, "flat_events"), "f", "_msg_id", "event_id", "part_no").unionByName(
        dedup.deliveries(table(spark, sf_dir, "chat_messages"), "c", "id", "row_id")
    )
    return dedup.surplus(spark, rows).select(
        F.when(F.col("key").startswith("f|"), "flat_events").otherwise("chat_messages").alias("src_table"), "row_id"
    )


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.edges(table(spark, sf_dir, "spans"), "spans", "trace_id", "span_id", "parent_span_id").unionByName(
        hierarchy.edges(table(spark, sf_dir, "tool_calls"), "tool_calls", "session_id", "id", "parent_tool_use_id")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root and number of descendants of every span and tool call, and the loops."""
    return hierarchy.contract(_links(spark, sf_dir)).select(*hierarchy.RESULT)


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every node, with their distance."""
    return hierarchy.descendants(hierarchy.contract(_links(spark, sf_dir)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and usage counters of every transcript line, linked to the block or object around them."""
    return shred.transcript_children(table(spark, sf_dir, "transcript_lines"))


def p4_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf value of the transcript lines with its repeated ancestor and definition level."""
    return shred.transcript_leaves(table(spark, sf_dir, "transcript_lines"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that were added, removed, renamed or changed type from one result file to the next."""
    return drift.changes(table(spark, sf_dir, "artifact_records"))


def p6_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records in one table: a row for each field of a record, in typed branches and in canonical form."""
    return drift.unified(table(spark, sf_dir, "artifact_records"))


def p4_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript lines without rows in p4_found, and why."""
    return shred.rejects(table(spark, sf_dir, "transcript_lines"))


def p6_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without fields in p6_unified, and why."""
    return drift.rejects(table(spark, sf_dir, "artifact_records"))


QUERIES = {
    "p4_rejects": p4_rejects,
    "p6_rejects": p6_rejects,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_leaves": p4_leaves,
    "p5_found": p5_found,
    "p5_descendants": p5_descendants,
    "p6_found": p6_found,
    "p6_unified": p6_unified,
}
_TRIM = r"'^[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+|[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+$', '', 'g'"

#: nodes; the trees from their roots down; all ancestors of tree nodes; the nodes that reach themselves.
_TREES = r"""
with recursive raw as (
  select 'spans' as src_table, trace_id as tree_id, span_id as node_id, parent_span_id as parent from spans
  union all select 'tool_calls', session_id, id, parent_tool_use_id from tool_calls),
one as (select src_table, tree_id, node_id, min(case when regexp_full_match(parent, '[\s0]*') then null else parent end) as parent
        from raw where tree_id is not null and node_id is not null group by all),
nodes as (select a.src_table, a.tree_id, a.node_id, b.node_id as parent from one a
          left join one b on a.src_table = b.src_table and a.tree_id = b.tree_id and a.parent = b.node_id),
down as (
  select src_table, tree_id, node_id, node_id as root_id, 0 as depth, node_id as node_path, [node_id] as parts from nodes where parent is null
  union all
  select n.src_table, n.tree_id, n.node_id, d.root_id, d.depth + 1, d.node_path || '/' || n.node_id, list_append(d.parts, n.node_id)
  from nodes n join down d on n.src_table = d.src_table and n.tree_id = d.tree_id and n.parent = d.node_id),
up as (select src_table, tree_id, node_id, p.anc, (depth - p.pos + 1)::int as distance from
        (select * from down where depth > 0),
        lateral (select unnest(parts[:-2]) as anc, generate_subscripts(parts[:-2], 1) as pos) p),
rest as (select * from nodes n where not exists (select 1 from down d where d.src_table = n.src_table and d.tree_id = n.tree_id and d.node_id = n.node_id)),
walk as (
  select src_table, tree_id, node_id as origin, parent as head from rest
  union
  select w.src_table, w.tree_id, w.origin, r.parent from walk w join rest r on w.src_table = r.src_table and w.tree_id = r.tree_id and w.head = r.node_id),
loops as (select distinct src_table, tree_id, origin as node_id from walk where origin = head)
"""

#: Content as a list: an array's elements, a string or an object alone; and the type of a block.
_LIST = "case json_type({0}) when 'ARRAY' then json_extract({0}, '$[*]') when 'VARCHAR' then [{0}] when 'OBJECT' then [{0}] end"
_CHILDREN = rf"""
with recursive o as (select * from (select line_id, case when json_valid(line) then line::json end as j from transcript_lines) where json_type(j) = 'OBJECT'),
m as (select line_id, j, case json_type(j, '$.message') when 'OBJECT' then j -> '$.message'
        when 'VARCHAR' then case when json_valid(j ->> '$.message') then case when json_type(j ->> '$.message') = 'OBJECT' then (j ->> '$.message')::json end end end as m from o),
blocks as (
  select line_id, e, pos::varchar as node_path, '' as parent_path from (
    select line_id, unnest(l) as e, generate_subscripts(l, 1) - 1 as pos from (select line_id, {_LIST.format("(m -> '$.content')")} as l from m where m is not null))
  union all
  select line_id, e, parent || '.' || pos, parent from (
    select line_id, parent, unnest(l) as e, generate_subscripts(l, 1) - 1 as pos from (
      select line_id, node_path as parent, {_LIST.format("(e -> '$.content')")} as l from blocks where json_type(e) = 'OBJECT'))),
counters as (
  select line_id, v, k, k as node_path, '' as parent_path from (select line_id, v, unnest(json_keys(v)) as k from (
    select line_id, m -> '$.usage' as v from m where m is not null union all select line_id, j -> '$.usage' from m) where json_type(v) = 'OBJECT')
  union all
  select line_id, v, k, parent || '.' || k, parent from (select line_id, v, parent, unnest(json_keys(v)) as k from (
    select line_id, node_path as parent, json_extract(v, '$."' || k || '"') as v from counters) where json_type(v) = 'OBJECT'))
select line_id, 'block' as child, node_path, parent_path, case json_type(e) when 'VARCHAR' then 'text' when 'OBJECT' then case json_type(e, '$.type') when 'VARCHAR' then e ->> '$.type' else '' end else '' end as tag
from blocks where json_type(e) <> 'NULL'
union all
select line_id, 'usage', node_path, parent_path, '' from counters where json_type(json_extract(v, '$."' || k || '"')) in ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"""

ORACLES = {
    "p4_found": _CHILDREN,
    "p4_rejects": r"""select line_id, case when line is null then 'missing' when not json_valid(line) then 'broken' else 'no object' end as reason
from transcript_lines where line is null or not json_valid(line) or json_type(case when json_valid(line) then line end) <> 'OBJECT'""",
    "p6_rejects": r"""select record_id, case when body is null then 'missing' when not json_valid(body) then 'broken' else 'no object' end as reason
from artifact_records where body is null or not json_valid(body) or json_type(case when json_valid(body) then body end) <> 'OBJECT'""",
    "p2_found": f"""
with d as (
  select 'flat_events' as src_table, event_id as row_id, lower(regexp_replace(_msg_id, {_TRIM})) as k, part_no, received_at from flat_events
  union all
  select 'chat_messages', row_id, lower(regexp_replace(id, {_TRIM})), null, received_at from chat_messages)
select src_table, row_id from (
  select *, row_number() over (partition by src_table, k, part_no order by received_at nulls last, row_id) as n from d where k <> '')
where n > 1""",
    "p5_found": _TREES
    + """
select src_table, tree_id, node_id, 'tree' as status, root_id, depth, node_path,
       (select count(*) from up b where b.src_table = a.src_table and b.tree_id = a.tree_id and b.anc = a.node_id)::int as n_below
from down a
union all
select n.src_table, n.tree_id, n.node_id, case when l.node_id is null then 'under_cycle' else 'cycle' end, '', -1, '', -1
from nodes n left join loops l using (src_table, tree_id, node_id)
where not exists (select 1 from down d where d.src_table = n.src_table and d.tree_id = n.tree_id and d.node_id = n.node_id)""",
    "p5_descendants": _TREES + "select src_table, tree_id, anc as ancestor_id, node_id, distance from up",
}
