"""Packets of cited rows under a budget: references stay whole, whatever is taken out.

A packet's rows cite sources. `whole` takes out rows that cite what is not there, sources that nothing cites, and sources made from sources that went, until nothing
changes. `fit` then takes rows out in a fixed order, field by field and the last row of a field first, until the rest fits. A source goes with the last
row that cites it, or the last source made from it, so the cost after each removal is a running sum over the order in which rows and sources go; the least number of removals is read from it, without
a loop. So no citation is left without its source for any budget.

Packets whose sources are not made from others need no loop: `packed` deals rows, citations and sources out by packet once, and all else are windows within the packet.

A packet's rows are bounded by who selects them; required rows and sources are kept to the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stage

#: Fields in the order in which they give way, and those without which a packet is insufficient.
GIVES_WAY = ("implementation_guidance", "symbols", "likely_files", "semantic_checks", "compile", "tests", "acceptance_conditions", "forbidden_changes", "required_invariants")
CRITICAL = ("acceptance_conditions", "forbidden_changes", "required_invariants")
LAST = 1 << 40


def whole(rows: DataFrame, citations: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (packet_id, row_id, ..), citations (packet_id, row_id, evidence_id), sources (packet_id, evidence_id, required, and parent if a source is made from another) -> the same, consistent.

    A row needs a citation, and all of its sources; a source needs a row that cites it, or a source made from it, or to be required.
    """
    sources = sources if "parent" in sources.columns else sources.withColumn("parent", F.lit(None).cast("string"))
    names, before = list(rows.columns), None
    rows, sources = stage(rows, "packet_rows"), stage(sources, "packet_sources")
    while True:
        now = (rows.count(), sources.count())
        if now == before:
            break
        before = now
        there = sources.select(F.col("packet_id").alias("p"), F.col("evidence_id").alias("e"))
        lost = citations.join(there, (F.col("packet_id") == F.col("p")) & (F.col("evidence_id") == F.col("e")), "left_anti").select(F.col("packet_id").alias("lp"), F.col("row_id").alias("lr")).distinct()
        cited = citations.select(F.col("packet_id").alias("cp"), F.col("row_id").alias("cr")).distinct()
        rows = rows.join(lost, (F.col("packet_id") == F.col("lp")) & (F.col("row_id") == F.col("lr")), "left_anti").join(cited, (F.col("packet_id") == F.col("cp")) & (F.col("row_id") == F.col("cr")), "left_semi")
        rows = stage(rows.select(*names), "packet_rows")
        kept = rows.select(F.col("packet_id").alias("kp"), F.col("row_id").alias("kr"))
        used = citations.join(kept, (F.col("packet_id") == F.col("kp")) & (F.col("row_id") == F.col("kr")), "left_semi").select("packet_id", "evidence_id")
        made = sources.where("parent is not null").select("packet_id", F.col("parent").alias("evidence_id"))
        used = used.union(made).distinct().select(F.col("packet_id").alias("up"), F.col("evidence_id").alias("ue"))
        orphan = sources.join(there, (F.col("packet_id") == F.col("p")) & (F.col("parent") == F.col("e")), "left").where("parent is null or e is not null").drop("p", "e")
        orphan = orphan.join(used, (F.col("packet_id") == F.col("up")) & (F.col("evidence_id") == F.col("ue")), "left").where("required or ue is not null")
        sources = stage(orphan.drop("up", "ue"), "packet_sources")
    kept = rows.select(F.col("packet_id").alias("kp"), F.col("row_id").alias("kr"))
    return rows, citations.join(kept, (F.col("packet_id") == F.col("kp")) & (F.col("row_id") == F.col("kr")), "left_semi"), sources


def _with_parents(held: DataFrame) -> DataFrame:
    """A source goes with the last that is made from it, if that is later than its own."""
    held, before = stage(held, "packet_held"), None
    while (now := held.agg(F.sum("goes")).first()[0]) != before:
        before = now
        child = held.where("parent is not null").groupBy(F.col("packet_id").alias("pp"), F.col("parent").alias("pe")).agg(F.max("goes").alias("later"))
        held = held.join(child, (F.col("packet_id") == F.col("pp")) & (F.col("evidence_id") == F.col("pe")), "left").withColumn("goes", F.greatest("goes", F.coalesce("later", F.lit(0)))).drop("pp", "pe", "later")
        held = stage(held, "packet_held")
    return held


def fit(rows: DataFrame, citations: DataFrame, sources: DataFrame, budget: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (packet_id, row_id, field, pos, cost, required), citations, sources (packet_id, evidence_id, cost, required), consistent -> rows and sources that stay,
    and for each packet: status, cost, omitted (rows taken out by field)."""
    at = F.array_position(F.array(*[F.lit(f) for f in GIVES_WAY]), F.col("field"))
    order = Window.partitionBy("packet_id").orderBy(F.col("required"), at, F.col("pos").desc(), F.col("row_id").desc())
    gone = rows.withColumn("goes", F.row_number().over(order).cast("long"))
    by_row = gone.select(F.col("packet_id").alias("gp"), F.col("row_id").alias("gr"), F.col("goes"))
    last = citations.join(by_row, (F.col("packet_id") == F.col("gp")) & (F.col("row_id") == F.col("gr"))).groupBy(F.col("gp").alias("sp"), F.col("evidence_id").alias("se")).agg(F.max("goes").alias("last"))
    held = sources.join(last, (F.col("packet_id") == F.col("sp")) & (F.col("evidence_id") == F.col("se")), "left").withColumn("goes", F.when(F.col("required"), F.lit(LAST)).otherwise(F.coalesce("last", F.lit(0)))).drop("sp", "se", "last")
    held = _with_parents(held) if "parent" in sources.columns else held
    held = held.where("goes > 0")  # nothing cites the others
    # What is left after k removals costs as much as all that goes later than k.
    costs = gone.select("packet_id", "goes", "cost").union(held.select("packet_id", "goes", "cost")).groupBy("packet_id", "goes").agg(F.sum("cost").alias("cost"))
    later = Window.partitionBy("packet_id").orderBy(F.col("goes").desc())
    left = costs.withColumn("with", F.sum("cost").over(later))
    fits = left.where(F.col("with") <= budget).groupBy(F.col("packet_id").alias("fp")).agg(F.min("goes").alias("first"), F.max("with").alias("left"))
    packets = costs.select("packet_id").distinct().join(fits, F.col("packet_id") == F.col("fp"), "left")
    # Nothing fits: all rows go, required sources stay.
    packets = packets.select(F.col("packet_id").alias("q"), F.coalesce("first", F.lit(LAST)).alias("first"))
    stays = lambda df: df.join(packets, F.col("packet_id") == F.col("q")).withColumn("stays", F.col("goes") >= F.col("first")).drop("q", "first")
    own, held = stays(gone), stays(held)
    critical = F.count_if(~F.col("stays") & (F.col("field").isin(*CRITICAL) | F.col("required"))) > 0
    omitted = own.where("not stays").groupBy("packet_id", "field").agg(F.count("*").alias("n")).groupBy(F.col("packet_id").alias("op")).agg(F.array_sort(F.collect_list(F.struct("field", "n"))).alias("omitted"))
    state = own.groupBy("packet_id").agg(critical.alias("critical"), F.count_if("stays").alias("rows"), F.sum(F.when(F.col("stays"), F.col("cost")).otherwise(0)).alias("row_cost"))
    from_sources = held.groupBy(F.col("packet_id").alias("hp")).agg(F.count_if("stays").alias("sources"), F.sum(F.when(F.col("stays"), F.col("cost")).otherwise(0)).alias("source_cost"))
    state = state.join(from_sources, F.col("packet_id") == F.col("hp"), "left").join(omitted, F.col("packet_id") == F.col("op"), "left")
    status = F.when(F.col("critical") | (F.coalesce("sources", F.lit(0)) == 0) | (F.col("rows") == 0), "insufficient_evidence").when(F.col("omitted").isNotNull(), "truncated").otherwise("ok")
    state = state.select("packet_id", status.alias("status"), F.col("rows"), F.coalesce("sources", F.lit(0)).alias("sources"), (F.col("row_cost") + F.coalesce("source_cost", F.lit(0))).alias("cost"), F.coalesce("omitted", F.expr("cast(array() as array<struct<field:string,n:bigint>>)")).alias("omitted"))
    return own.where("stays").drop("stays", "goes"), held.where("stays").drop("stays", "goes"), state


def by_packet(df: DataFrame) -> DataFrame:
    """df, dealt out by packet alone and always into as many parts: what lies so already is not shuffled again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "packet_id")


def _items(rows: DataFrame, citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations, rows and sources as rows of one table, by packet."""
    columns = {"row_id": "string", "evidence_id": "string", "field": "string", "pos": "int", "cost": "long", "required": "boolean"}
    for df in (rows, citations, sources):
        columns |= {c: t for c, t in df.dtypes if c in columns}
    own = lambda df, what: df.select("packet_id", F.lit(what).alias("what"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
    return by_packet(own(citations, "citation").union(own(rows.drop("evidence_id"), "row")).union(own(sources.drop("row_id"), "source")))


def packed(rows: DataFrame, citations: DataFrame, sources: DataFrame, budget: int, *, staged: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """`fit` of `whole`: rows that stay, citations before the budget, sources that stay, and for each packet its state. staged: what they are read from is written once, for callers that need several."""
    if "parent" in sources.columns:
        rows, citations, sources = whole(rows, citations, sources)
        kept, held, state = fit(rows, citations, sources, budget)
        return kept, citations, held, state
    what, at = F.col("what"), F.array_position(F.array(*[F.lit(f) for f in GIVES_WAY]), F.col("field"))
    packet, by_row, by_source = Window.partitionBy("packet_id"), Window.partitionBy("packet_id", "row_id"), Window.partitionBy("packet_id", "evidence_id")
    order = Window.partitionBy("packet_id", "what").orderBy("required", at, F.col("pos").desc(), F.col("row_id").desc())
    cites, goes = what == "citation", F.when(what == "row", F.col("goes"))
    items = _items(rows, citations, sources).withColumn("there", F.col("evidence_id").isNotNull() & (F.count_if(what == "source").over(by_source) > 0))
    items = items.withColumn("goes", F.row_number().over(order).cast("long"))
    # Rows with a citation, and all of their sources; their citations; sources that these cite, or that are required.
    items = items.withColumns({"cited": F.count_if(cites).over(by_row), "lost": F.count_if(cites & ~F.col("there")).over(by_row), "goes": F.when(what != "source", F.coalesce(goes, F.max(goes).over(by_row)))})
    items = items.where((what == "source") | (F.col("row_id").isNotNull() & (F.col("cited") > 0) & (F.col("lost") == 0) & F.col("goes").isNotNull()))
    last = F.max(F.when(cites, F.col("goes"))).over(by_source)
    items = items.withColumn("goes", F.when(what != "source", F.col("goes")).when(F.col("required"), F.lit(LAST)).when(F.col("evidence_id").isNotNull(), last)).where("goes is not null")
    # What is left after k removals costs as much as all that goes later than k.
    items = items.withColumn("with", F.sum(F.when(~cites, F.col("cost")).otherwise(0)).over(packet.orderBy(F.col("goes").desc())))
    items = items.withColumn("stays", F.col("goes") >= F.coalesce(F.min(F.when(F.col("with") <= budget, F.col("goes"))).over(packet), F.lit(LAST))).drop("there", "cited", "lost", "with", "goes")
    items = stage(items, "packed") if staged else items
    row, source, stays = what == "row", what == "source", F.col("stays")
    critical = F.count_if(row & ~stays & (F.col("field").isin(*CRITICAL) | F.col("required"))) > 0
    state = items.groupBy("packet_id").agg(
        critical.alias("critical"), F.count_if(row & stays).alias("rows"), F.count_if(source & stays).alias("sources"), F.sum(F.when(stays & ~cites, F.col("cost")).otherwise(0)).alias("cost"), F.count_if(row).alias("of"),
        *[F.count_if(row & ~stays & (F.col("field") == f)).alias(f) for f in GIVES_WAY],
    ).where("of > 0")
    omitted = F.array_sort(F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in GIVES_WAY]), lambda x: x["n"] > 0))
    status = F.when(F.col("critical") | (F.col("sources") == 0) | (F.col("rows") == 0), "insufficient_evidence").when(F.col("rows") < F.col("of"), "truncated").otherwise("ok")
    state = state.select("packet_id", status.alias("status"), "rows", "sources", "cost", omitted.alias("omitted"))
    return items.where(row & stays).select("packet_id", "row_id", "field", "pos", "cost", "required"), items.where(cites).select("packet_id", "row_id", "evidence_id"), items.where(source & stays).select("packet_id", "evidence_id", "cost", "required"), state


def errors(rows: DataFrame, citations: DataFrame, sources: DataFrame) -> DataFrame:
    """packet_id, error, id: rows without a citation, citations without a source, sources without a citation, evidence and rows named twice."""
    what, by_row = F.col("what"), Window.partitionBy("packet_id", "row_id")
    items = _items(rows, citations, sources).select("packet_id", "what", "row_id", "evidence_id", "required")
    items = items.withColumns({"cited": (F.count_if(what == "citation").over(by_row) > 0) & F.col("row_id").isNotNull(), "rows": F.count_if(what == "row").over(by_row), "first": F.row_number().over(by_row.orderBy(what != "row")) == 1})
    live = F.count_if((what == "citation") & (F.col("rows") > 0) & F.col("row_id").isNotNull())
    error = lambda when, name, c, n=F.lit(1): F.when(when, F.array_repeat(F.struct(F.lit(name).alias("error"), F.col(c).cast("string").alias("id")), n.cast("int")))
    none = F.expr("cast(array() as array<struct<error:string,id:string>>)")
    of_rows = F.concat(*[F.coalesce(e, none) for e in (error((what == "row") & ~F.col("cited"), "row_without_citation", "row_id"), error((what == "row") & F.col("first") & (F.col("rows") > 1), "repeated_row", "row_id"))])
    found = items.withColumn("of_row", F.when(F.size(of_rows) > 0, of_rows)).groupBy("packet_id", "evidence_id").agg(F.flatten(F.collect_list("of_row")).alias("of_rows"), live.alias("live"), F.count_if(what == "source").alias("sources"), F.count_if((what == "source") & ~F.col("required")).alias("free"))
    known, cited = F.col("evidence_id").isNotNull() & (F.col("sources") > 0), F.col("evidence_id").isNotNull() & (F.col("live") > 0)
    of_sources = (error((F.col("live") > 0) & ~known, "citation_without_source", "evidence_id"), error(~cited, "source_without_citation", "evidence_id", F.col("free")), error(F.col("sources") > 1, "repeated_evidence", "evidence_id"))
    every = F.concat("of_rows", *[F.coalesce(e, none) for e in of_sources])
    return found.select("packet_id", F.explode(every).alias("e")).select("packet_id", "e.error", "e.id")
