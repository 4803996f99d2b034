"""Queries of packets. An order is a packet: its positions are the rows, its suppliers the sources that they cite."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import packets as P
from ..runtime import table

QUERIES, SQL = {}, {}
BUDGET = 100


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def order_packets(spark, sf):
    """Positions by flag: R is guidance, A symbols, N invariants. A position costs its quantity, a supplier 20; suppliers of even keys are known, the first of each order is required."""
    lines = P.by_packet(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("packet_id"), F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("row_id"), F.col("l_suppkey").cast("string").alias("evidence_id"), "l_returnflag", "l_linenumber", F.col("l_quantity").cast("long").alias("cost")))
    lines = lines.groupBy("packet_id", "row_id", "evidence_id").agg(F.min("l_returnflag").alias("flag"), F.min("l_linenumber").cast("int").alias("pos"), F.min("cost").alias("cost"))
    field = F.when(F.col("flag") == "R", "implementation_guidance").when(F.col("flag") == "A", "symbols").otherwise("required_invariants")
    rows = lines.select("packet_id", "row_id", field.alias("field"), "pos", "cost", F.lit(False).alias("required"))
    sources = lines.where(F.col("evidence_id").cast("long") % 4 < 3).groupBy("packet_id", "evidence_id").agg(F.lit(20).cast("long").alias("cost"), F.lit(False).alias("required"))
    return rows, lines.select("packet_id", "row_id", "evidence_id"), sources


_PACKETS = f"""l as (select l_orderkey p, concat_ws('/', l_linenumber, l_partkey, l_suppkey, l_quantity::int) r, l_suppkey e, min(l_returnflag) flag, min(l_linenumber) pos, min(l_quantity::bigint) cost from lineitem group by 1, 2, 3 having e % 4 < 3),
o as (select *, row_number() over (partition by p order by case flag when 'R' then 1 when 'A' then 2 else 9 end, pos desc, r desc) goes from l),
i as (select p, goes, cost from o union all select p, max(goes), 20 from o group by p, e),
c as (select p, goes, sum(sum(cost)) over (partition by p order by goes desc) total from i group by p, goes),
f as (select p, min(goes) filter (total <= {BUDGET}) first from c group by p)"""


@query(f"with {_PACKETS} select p packet_id, r row_id, case flag when 'R' then 'implementation_guidance' when 'A' then 'symbols' else 'required_invariants' end field from o join f using (p) where goes >= first")
def packet_rows(spark, sf):
    """EVS-14, EVS-16: what stays of each packet: rows with all of their sources, within the budget."""
    return P.packed(*order_packets(spark, sf), BUDGET)[0].select("packet_id", "row_id", "field")


@query(
    f"""with {_PACKETS}, k as (select o.*, coalesce(goes >= first, false) stays from o join f using (p)), s as (select p, count(distinct e) filter (stays) sources from k group by 1)
    select p packet_id, case when count(*) filter (not stays and flag not in ('R', 'A')) > 0 or count(*) filter (stays) = 0 then 'insufficient_evidence' when count(*) filter (not stays) > 0 then 'truncated' else 'ok' end status,
    count(*) filter (stays) "rows", any_value(sources) sources, (coalesce(sum(cost) filter (stays), 0) + 20 * any_value(sources))::bigint cost from k join s using (p) group by p"""
)
def packet_states(spark, sf):
    """EVS-14, EVS-16: each packet's status, and what it holds after its budget."""
    return P.packed(*order_packets(spark, sf), BUDGET)[3].select("packet_id", "status", "rows", "sources", "cost")


@query("select l_orderkey packet_id, 'citation_without_source' error, l_suppkey::varchar id from lineitem where l_suppkey % 4 = 3 group by all")
def packet_errors(spark, sf):
    """EVS-15: what is wrong with the packets before they are made whole: suppliers that are cited and not known."""
    return P.errors(*order_packets(spark, sf))


@query("select 0::bigint errors, count(distinct l_orderkey) packets from lineitem where l_suppkey % 4 < 3")
def packet_integrity(spark, sf):
    """EVS-15: after the budget no packet has an error of reference."""
    kept, citations, held, state = P.packed(*order_packets(spark, sf), BUDGET, staged=True)
    found = P.errors(kept, citations, held).agg(F.count("*").alias("errors")).withColumn("k", F.lit(0))
    return found.join(state.agg(F.count("*").alias("packets")).withColumn("k", F.lit(0)), "k").select("errors", "packets")


@query(
    """with m as (select l_suppkey c, l_returnflag || l_linestatus r, sum(l_quantity)::bigint q, count(*) n, min(l_quantity)::bigint low from lineitem group by 1, 2),
    p as (select a.c, a.r, b.r o, b.q > a.q gq, b.n < a.n gn, b.low > a.low gl, b.q >= a.q and b.n <= a.n and b.low >= a.low and (b.q > a.q or b.n < a.n or b.low > a.low) beats from m a left join m b on a.c = b.c and a.r <> b.r)
    select c case_id, r run, coalesce(string_agg(o, ',' order by o) filter (beats), '') beaten_by, concat_ws(',', case when not coalesce(bool_or(gl), false) then 'least' end, case when not coalesce(bool_or(gn), false) then 'positions' end, case when not coalesce(bool_or(gq), false) then 'quantity' end) best_in from p group by 1, 2"""
)
def skylines(spark, sf):
    """EVL-13: of each supplier's groups of positions those that no other beats in quantity (more), number (fewer) and least quantity (more)."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("case_id"), F.concat("l_returnflag", "l_linestatus").alias("run")).agg(F.sum("l_quantity").alias("quantity"), F.count("*").cast("double").alias("positions"), F.min("l_quantity").alias("least"))
    metrics = rows.unpivot(["case_id", "run"], ["quantity", "positions", "least"], "metric", "value")
    got = G.skyline(metrics, {"quantity": "up", "positions": "down", "least": "up"})
    return got.select("case_id", "run", F.array_join("beaten_by", ",").alias("beaten_by"), F.array_join("best_in", ",").alias("best_in"))
