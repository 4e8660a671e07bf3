"""The model's tables, derived from the tables of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ids a document has for its lines.
LINES = 1_000_000


def _chunk_id(doc: Column, pos: Column) -> Column:
    """Distinct for each line: lines beyond LINES are numbered among the negative ids, where a document may have 2^31 of them."""
    return F.when(pos < LINES, doc * LINES + pos).otherwise(-(doc * F.lit(1 << 31) + pos))


class Model:
    """Files, chunks, symbols, call edges, events and diagnostics over one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def files(self) -> DataFrame:
        d = self.table("documents")
        path = F.concat("source", F.lit("/"), "doc_id", F.lit("."), "lang")
        return d.select(path.alias("file_path"), F.substring(F.sha2("text", 256), 1, 32).alias("content_hash"), F.octet_length("text").cast("long").alias("file_size"))

    def chunks(self) -> DataFrame:
        """One chunk a line that isn't empty; the first line of a document may have an embedding."""
        d = self.table("documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text")).filter("text <> ''")
        kind = F.when(F.col("lang") == "en", "function").when(F.col("lang") == "fr", "method").when(F.col("lang") == "de", "type").otherwise("other")
        return d.select(
            _chunk_id(F.col("doc_id"), F.col("pos")).alias("chunk_id"),
            F.concat("source", F.lit("/"), "doc_id", F.lit("."), "lang").alias("file_path"),
            F.col("pos").cast("int").alias("start_line"),
            F.concat(F.lit("Doc"), "doc_id", F.lit("."), F.regexp_extract("text", "[A-Za-z]+", 0)).alias("symbol_path"),
            kind.alias("kind"),
            "text",
        )

    def embedded(self) -> DataFrame:
        """chunk_id and embedding: the vector of a document lies on its first line."""
        return self.table("embeddings").select((F.col("vec_id") * LINES).alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def vectors(self) -> DataFrame:
        """Chunks that are known by their vectors only."""
        v = self.table("embeddings")
        kind = F.element_at(F.array(*map(F.lit, ("function", "method", "type", "other"))), (F.col("label") % 4 + 1).cast("int"))
        return v.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("f"), "label").alias("file_path"), F.concat(F.lit("v"), "vec_id").alias("symbol_path"), kind.alias("kind"), "embedding")

    def code_chunks(self) -> DataFrame:
        p = self.table("part")
        kind = F.element_at(F.array(*map(F.lit, ("function", "method", "type", "other"))), (F.col("p_size") % 4 + 1).cast("int"))
        line = F.floor(F.col("p_partkey") / 25).cast("int")
        return p.select(
            F.col("p_partkey").alias("chunk_id"),
            F.concat(F.lit("src/n"), F.col("p_partkey") % 25, F.lit(".py")).alias("file_path"),
            line.alias("start_line"),
            (line + F.col("p_size")).cast("int").alias("end_line"),
            F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("symbol_path"),
            kind.alias("kind"),
            F.concat_ws(" ", "p_type", "p_name").alias("text"),
        )

    def symbols(self) -> DataFrame:
        c = self.table("customer")
        line = F.floor(F.col("c_custkey") / 15).cast("int")
        kind = F.element_at(F.array(*map(F.lit, ("function", "class", "method", "struct", "variable"))), (F.col("c_custkey") % 5 + 1).cast("int"))
        return c.select(
            F.col("c_custkey").alias("symbol_id"),
            F.replace("c_name", F.lit("#"), F.lit("_")).alias("name"),
            kind.alias("kind"),
            F.concat(F.lit("src/n"), "c_nationkey", F.lit(".py")).alias("file_path"),
            line.alias("start_line"),
            F.lit(4).alias("start_column"),
            (line + 3).cast("int").alias("end_line"),
            F.lit(0).alias("end_column"),
            F.when(F.col("c_acctbal") > 0, F.concat(F.lit("fn "), F.lower("c_mktsegment"))).alias("detail"),
        )

    def edges(self) -> DataFrame:
        """An order is a call of one customer's symbol to another's."""
        c = self.table("customer").select("c_custkey", "c_nationkey")
        n = self.table("customer").agg(F.count("*").alias("n"))
        o = self.table("orders").crossJoin(F.broadcast(n)).join(c, F.col("o_custkey") == F.col("c_custkey"))
        return o.select(
            F.col("o_orderkey").alias("edge_id"),
            F.col("o_custkey").alias("caller_id"),
            ((F.col("o_orderkey") * 7 + 3) % F.col("n")).alias("callee_id"),
            F.concat(F.lit("src/n"), "c_nationkey", F.lit(".py")).alias("file_path"),
            F.concat(F.lit("[["), F.col("o_orderkey") % 100, F.lit(",0,"), F.col("o_orderkey") % 100 + 1, F.lit(",0],[1,2]]")).alias("from_ranges"),
            F.when(F.col("o_orderstatus") == "F", "treesitter").otherwise("lsp").alias("source"),
        )

    def file_events(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "removed").otherwise("modified")
        return self.table("events").select(F.col("event_id").alias("seq"), "ts", F.concat(F.lit("u"), "user_id").alias("path"), kind.alias("kind"))

    def diagnostics(self) -> DataFrame:
        severity = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 3).otherwise(4)
        return self.table("events").select(
            F.col("event_id").alias("diag_id"), F.concat(F.lit("src/n"), F.col("user_id") % 25, F.lit(".py")).alias("uri"), severity.alias("severity"), F.concat(F.lit("m"), "event_id").alias("message"), (F.col("event_id") % 100).cast("int").alias("start_line")
        )

    def nodes(self) -> DataFrame:
        """Syntax nodes of the pages: tags with kind and depth; depth is a running sum inside the page.
        """
        tags = self.table("pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<(/?[a-z][a-z0-9]*)[^>]*>"), F.lit(1))).alias("pos", "tag"))
        tags = tags.filter(~F.col("tag").isin("meta", "br", "img", "link", "hr", "input"))
        step = F.when(F.startswith("tag", F.lit("/")), -1).otherwise(1)
        w = Window.partitionBy("page_id").orderBy("pos")
        t = tags.withColumn("depth", F.sum(step).over(w).cast("int")).filter(~F.startswith("tag", F.lit("/")))
        return t.select(F.col("page_id").alias("file"), F.col("pos").cast("int").alias("node_id"), F.col("tag").alias("kind"), "depth")
