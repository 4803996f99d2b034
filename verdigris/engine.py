"""A library of documents: add, remove, list, inspect and query, over generations of Parquet tables.

    lib = Library.create(spark, path)
    lib.add(docs)                                  # source, content
    lib.query("set up a token", limit=8, budget=2400, expand="adjacent").show()

Every change writes a new generation beside the active one and then moves the pointer, so a job that dies leaves the library
as it was. Only documents that changed are chunked again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators.children import CHILD, Sizes, child_rows
from .operators import index as X
from .operators.retrieval import first_wins, utility
from .runtime import ship
from .sources.documents import read_documents
from .sources.files import read_files
from .sources.store import activate, active_generation, merge_by_source, unchanged, write_generation

DOCUMENT = "source string, content string, content_hash string, tokens long"
#: Rows up to which a ranking is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
EXPANSIONS = ("none", "adjacent", "page")
#: Members of one expansion.
NEIGHBOURS = 8


def search(chunks: DataFrame, queries: DataFrame, index: X.Index, *, limit: int = 8, budget: int = 2400, expand: str = "adjacent", where: Column | None = None) -> DataFrame:
    """chunks (id, and the columns of CHILD), queries (query_id, text), the chunks' index -> query_id, position, score and a chunk's columns.

    LEX-6: chunks with all terms in title, body or source (any, where a query has none with all), four times the limit, ordered by utility; each is followed
    by its neighbours in its section; repeated texts are dropped; a chunk over the budget is skipped, but never the first.
    """
    if expand not in EXPANSIONS:
        raise ValueError(f"expand is one of {EXPANSIONS}")
    scored = X.weighted_bm25(index, queries).withColumn("score", -F.col("cost"))
    if where is not None:
        chunks = chunks.where(where)
        scored = scored.join(chunks.select(F.col("child_id").alias("c")), F.col("id") == F.col("c"), "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    best = scored.withColumn("raw_rank", F.row_number().over(order)).where(F.col("raw_rank") <= 4 * limit).drop("full", "cost").withColumnRenamed("id", "child_id")
    small = queries.count() * 4 * limit <= BROADCAST_ROWS
    hint = F.broadcast if small else lambda d: d
    asked = hint(queries.select("query_id", F.col("text").alias("question")))
    title = F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.lit("Document"))
    value = utility(title, F.col("display_text"), F.col("question"), F.col("score"), F.col("tokens"), F.lit(""))
    rows = chunks.join(hint(best), "child_id").join(asked, "query_id")
    rows = rows.select("query_id", "child_id", "id", "parent_id", "ordinal", "kind", "atom_id", "raw_rank", value.alias("utility"))
    rows = rows.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("utility", 9).desc(), "child_id")))
    body = chunks.select(F.col("id").alias("source"), F.col("parent_id").alias("p"), F.col("ordinal").alias("o"), F.col("atom_id").alias("a"), F.col("child_id").alias("c"), F.col("tokens").cast("long").alias("cost"), F.sha2(F.concat(title, F.lit("\n"), "display_text"), 256).alias("h"))
    near = F.abs(F.col("o") - F.col("ordinal")) <= {"none": 0}.get(expand, 1)
    if expand == "page":
        near = near | (F.col("kind").isin("code", "table") & (F.col("a") == F.col("atom_id")))
    wide = body.join(hint(rows), (F.col("source") == F.col("id")) & (F.col("p") == F.col("parent_id")) & near)
    wide = wide.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "final_rank").orderBy("o"))).where(F.col("n") <= NEIGHBOURS)
    item = F.struct("final_rank", (F.col("c") != F.col("child_id")).alias("later"), "o", F.col("c").alias("id"), "h", "cost")
    start = F.expr("named_struct('used', 0L, 'ids', cast(array() as array<string>), 'hashes', cast(array() as array<string>))")

    def step(s: Column, x: Column) -> Column:
        new = ~F.array_contains(s.ids, x.id) & ~F.array_contains(s.hashes, x.h)
        room = (F.size(s.ids) == 0) | ((s.used < budget) & (F.size(s.ids) < limit) & (s.used + x.cost <= budget))
        return F.when(new & room, F.struct((s.used + x.cost).alias("used"), F.concat(s.ids, F.array(x.id)).alias("ids"), F.concat(s.hashes, F.array(x.h)).alias("hashes"))).otherwise(s)

    packed = wide.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items")).select("query_id", F.aggregate("items", start, step).alias("p"))
    picks = packed.select("query_id", F.col("p.used").alias("used"), F.posexplode("p.ids").alias("position", "child_id"))
    shown = F.greatest(F.lit(0.0), F.round(1 - 0.05 * F.col("position"), 2))
    trace = rows.select("query_id", "child_id", "raw_rank", "final_rank", "utility")
    return chunks.join(hint(picks), "child_id").join(hint(trace), ["query_id", "child_id"], "left").select("query_id", "position", shown.alias("score"), F.col("id").alias("source"), "child_id", "parent_id", "ordinal", "heading_path", F.col("display_text").alias("text"), "tokens", F.col("used").alias("packed_tokens"), "raw_rank", "final_rank", "utility")


def index_chunks(chunks: DataFrame, path: str, buckets: int = X.BUCKETS) -> X.Index:
    """The index of a generation's chunks: the last heading is the title, the document's name the source."""
    title = F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.lit("Document"))
    return X.build(chunks, path, id_col="child_id", body=F.col("search_text"), title=title, source=F.col("id"), buckets=buckets, store=False)


def counted_chunks(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """Chunks with their counts of a few terms, for an index of these alone; title and source as in `index_chunks`."""
    title = F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.lit("Document"))
    return X.counted(chunks, terms, body=F.col("search_text"), title=title, source=F.col("id"))


def format_context(results: DataFrame, style: str = "markdown") -> DataFrame:
    """query_id, context: a query's results as one text, in order. STR-34; results are bounded by the search's limit."""
    if style == "xml":
        safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
        line = F.concat(F.lit('<document source="'), safe(F.col("source")), F.lit('">\n'), safe(F.col("text")), F.lit("\n</document>"))
    elif style == "markdown":
        line = F.concat(F.lit("### "), F.array_join("heading_path", " > "), F.lit(" ("), "source", F.lit(")\n\n"), "text")
    else:
        raise ValueError("style is markdown or xml")
    rows = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("all"))
    return rows.select("query_id", F.array_join("all.line", "\n\n").alias("context"))


class Library:
    def __init__(self, spark: SparkSession, path: str, sizes: Sizes = Sizes(), buckets: int = X.BUCKETS):
        self.spark, self.path, self.sizes, self.buckets = ship(spark), path.rstrip("/"), sizes, buckets

    @classmethod
    def create(cls, spark: SparkSession, path: str, sizes: Sizes = Sizes(), buckets: int = X.BUCKETS) -> Library:
        lib = cls(spark, path, sizes, buckets)
        lib._publish(0, spark.createDataFrame([], DOCUMENT), spark.createDataFrame([], f"id string, {CHILD}"))
        return lib

    def _generation(self) -> int:
        return active_generation(self.spark, self.path)

    def _publish(self, generation: int, sources: DataFrame, chunks: DataFrame) -> None:
        write_generation(sources, f"{self.path}/sources", generation)
        write_generation(chunks, f"{self.path}/chunks", generation)
        index_chunks(self._chunks(generation), f"{self.path}/index/generation_id={generation}", self.buckets)
        activate(self.spark, self.path, generation)

    def sources(self) -> DataFrame:
        """source, content, content_hash, tokens."""
        return self.spark.read.schema(DOCUMENT).parquet(f"{self.path}/sources/generation_id={self._generation()}")

    def _chunks(self, generation: int) -> DataFrame:
        return self.spark.read.schema(f"id string, {CHILD}").parquet(f"{self.path}/chunks/generation_id={generation}")

    def chunks(self) -> DataFrame:
        """id (the source) and the columns of CHILD."""
        return self._chunks(self._generation())

    def index(self) -> X.Index:
        return X.Index(self.spark, f"{self.path}/index/generation_id={self._generation()}", self.buckets, id_type="string")

    def add(self, docs: DataFrame) -> None:
        """docs (source, content, ...): replaces documents of the same source; unchanged ones are left as they are. Of rows with one
        source the least content counts; rows without a source or text are left out."""
        new = docs.select(F.col("source").cast("string").alias("source"), F.col("content").cast("string").alias("content")).where("source is not null and trim(content) <> ''")
        new = first_wins(new, F.col("source"), [F.col("content")])
        new = new.select("source", "content", F.sha2("content", 256).alias("content_hash"), T.estimate_tokens(F.col("content")).alias("tokens"))
        stored, chunks = self.sources(), self.chunks()
        same = unchanged(new, stored).select("source")
        new = new.join(same, "source", "left_anti")
        kept = chunks.join(new.select(F.col("source").alias("id")), "id", "left_anti")
        self._publish(self._generation() + 1, merge_by_source(stored, new), kept.unionByName(child_rows(new, "source", "content", self.sizes)))

    def ingest(self, folder: str) -> DataFrame:
        """Adds a folder's files; returns those skipped (source, reason)."""
        text, left = read_files(self.spark, folder)
        office, broken = read_documents(self.spark, folder)
        self.add(text.select("source", "content").unionByName(office.select("source", "content")))
        known = left.where(~F.lower("source").rlike(r"\.(docx|rtf|pdf)$"))
        return known.unionByName(broken)

    def remove(self, where: Column) -> None:
        """Deletes the sources for which a condition on source holds."""
        gone = F.coalesce(where, F.lit(False))
        sources = self.sources()
        doomed = sources.where(gone).select(F.col("source").alias("id"))
        self._publish(self._generation() + 1, sources.where(~gone), self.chunks().join(doomed, "id", "left_anti"))

    def query(self, text: str, **options) -> DataFrame:
        """The packed results of one question, in order."""
        return search(self.chunks(), self.spark.createDataFrame([(1, text)], "query_id int, text string"), self.index(), **options).drop("query_id").orderBy("position")

    def query_many(self, queries: DataFrame, **options) -> DataFrame:
        return search(self.chunks(), queries, self.index(), **options)

    def savings(self, results: DataFrame) -> DataFrame:
        """query_id, packed, raw (the whole sources of the results, each once), percent, runway. AGG-9."""
        hit = results.groupBy("query_id", "source").agg(F.sum("tokens").alias("packed"))
        rows = hit.join(self.sources().select("source", F.col("tokens").alias("raw")), "source").groupBy("query_id").agg(F.sum("packed").alias("packed"), F.sum("raw").alias("raw"))
        return rows.withColumn("percent", F.greatest(F.lit(0.0), F.round(100 * (1 - F.col("packed") / F.col("raw")), 1))).withColumn("runway", F.round(F.col("raw") / F.col("packed"), 2))

    def stats(self) -> DataFrame:
        """sources, chunks, tokens, oversize: one row."""
        a = self.sources().agg(F.count("*").alias("sources"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
        b = self.chunks().agg(F.count("*").alias("chunks"), F.count_if(~F.col("fits")).alias("oversize"))
        return a.crossJoin(b)

    def duplicates(self) -> DataFrame:
        """content_hash, copies, first_source of texts that several sources hold."""
        return self.sources().groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("source").alias("first_source")).where("copies > 1")
