"""Sources. Every schema that is fixed is declared; nothing is inferred but logs, which are read permissively."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as TX
from ..operators.lineage import cut, once

DOCUMENT = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source_type", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("title", T.StringType()), T.StructField("fetched_at", T.DoubleType()), T.StructField("doc_id", T.StringType()),
])
LOG = "step long, loss double, lr double, grad_norm double, tokens_seen long, tokens_per_second double, val_loss double, val_perplexity double, elapsed double, event string"


def read_shards(spark: SparkSession, *paths: str, pattern: str = "*.jsonl*", strict: bool = True) -> DataFrame:
    """Documents of JSON-lines shards (plain, gzip or zst) with rank = (directory, file, row): directories in the order given,
    files by name, rows as written. A shard is one task, as compressed files can't be split; convert to Parquet once."""
    parts = []
    for i, path in enumerate(paths):
        reader = spark.read.schema(DOCUMENT).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("pathGlobFilter", pattern)
        d = reader.json(path).select("*", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_row"))
        parts.append(d.withColumn("rank", F.struct(F.lit(i).alias("dir"), F.col("_file").alias("file"), F.col("_row").alias("row"))).drop("_file", "_row"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validated(docs: DataFrame) -> DataFrame:
    """Defaults of missing fields, ids of texts, and an error for a wrong source_type."""
    known = F.col("source_type").isin("manual", "downloaded")
    kind = F.when(known, F.col("source_type")).otherwise(F.raise_error(F.concat(F.lit("source_type: "), F.coalesce("source_type", F.lit("null")))).cast("string"))
    return docs.withColumn("source_type", kind).withColumn("url", F.coalesce("url", F.lit(""))).withColumn("title", F.coalesce("title", F.lit(""))).withColumn(
        "doc_id", F.coalesce("doc_id", F.substring(F.sha1("text"), 1, 16))
    )


def write_shards(docs: DataFrame, path: str, by: list[str] | None = None, rows: int = 25_000) -> None:
    """Parquet shards of at most so many rows; dynamic overwrite makes a work unit repeatable, _SUCCESS marks it whole."""
    w = docs.write.mode("overwrite").option("maxRecordsPerFile", rows).option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*by) if by else w).parquet(path)


def first_rows(docs: DataFrame, n: int) -> DataFrame:
    return docs.orderBy("rank").limit(n)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log events; broken lines and lines without a step are left out."""
    return spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path).where("step IS NOT NULL")


def log_series(log: DataFrame) -> DataFrame:
    """(series, step, value): each event feeds the series whose key it has."""
    names = ["loss", "lr", "val_loss", "tokens_per_second"]
    return log.select("step", F.expr(f"stack({len(names)}, {', '.join(f'{n!r}, {n}' for n in names)}) AS (series, value)")).where("value IS NOT NULL")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece, score) of a piece-tab-score file; a quote is an ordinary piece. Vocabularies are small files: one task."""
    v = spark.read.schema("piece string, score double").option("sep", "\t").option("quote", "").option("ignoreLeadingWhiteSpace", "false").csv(path).coalesce(1)
    return v.select(F.monotonically_increasing_id().cast("int").alias("id"), "piece", "score")


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of files, hashed where they lie."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "modificationTime")


def latest(files: DataFrame, keep: int, step: str = "step") -> DataFrame:
    """Retention of rolling checkpoints: adds kept for the newest ones."""
    return files.withColumn("kept", F.row_number().over(Window.orderBy(F.desc(step))) <= keep)


def sitemap_entries(xml: DataFrame, column: str = "xml") -> DataFrame:
    """(url, is_sitemap) of the loc elements: names in .xml or .xml.gz, queries aside, are further sitemaps."""
    loc = F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)))
    bare = F.lower(F.regexp_replace(F.col("url"), r"\?.*$", ""))
    return xml.select(loc.alias("url")).withColumn("is_sitemap", bare.endswith(".xml") | bare.endswith(".xml.gz"))


def frontier(candidates: DataFrame, cap: int) -> DataFrame:
    """candidates: (source, url, pos). Every url once, at its first place; at most cap a source."""
    once = candidates.groupBy("url").agg(F.min_by(F.struct("source", "pos"), F.struct("pos", "source")).alias("at")).select("at.source", "url", "at.pos")
    w = Window.partitionBy("source").orderBy("pos", "url")
    return once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).drop("n")


def pending(front: DataFrame, seen: DataFrame) -> DataFrame:
    return front.join(seen.select("url"), "url", "left_anti")


# Urls that carry no prose.
EXCLUDED = (
    r"(/photos?/|/photo-gallery|/video[s]?/|/web-stories/|/tag[s]?/|/topic/|"
    r"/author/|/category/|/live-|/cricket-score|\.(jpg|jpeg|png|gif|pdf|mp4)$)"
)


def wanted(url, include: str | None = None, exclude: str = EXCLUDED):
    ok = ~url.rlike("(?i)" + exclude) & F.startswith(url, F.lit("http"))
    return ok & url.rlike(include) if include else ok


def lookup(registry: DataFrame, names: list[str]) -> DataFrame:
    """The named rows in the order asked for; an unknown name is an error."""
    spark = registry.sparkSession
    asked = spark.createDataFrame(list(enumerate(names)), "pos int, name string")
    missing = [r["name"] for r in asked.join(registry, "name", "left_anti").collect()]  # as many as were asked for
    if missing:
        raise ValueError(f"unknown sources: {', '.join(sorted(missing))}")
    return asked.join(registry, "name").orderBy("pos")


def html_text(html):
    """An approximation of an article extractor: scripts, styles and site parts out, tags to line breaks, entities decoded."""
    t = html
    for tag in ("script", "style", "nav", "header", "footer", "aside", "form", "noscript"):
        t = F.regexp_replace(t, rf"(?is)<{tag}[\s>].*?</{tag}>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", ""), r"<[^>]+>", "\n")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def html_title(html):
    return F.regexp_extract(html, r"(?is)<title>\s*(.*?)\s*</title>", 1)


def month_windows(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(label, start, stop), newest first: half-open months, the last clamped to the end."""
    m = spark.sql(f"SELECT explode(sequence(trunc(date'{start}', 'month'), date'{end}', interval 1 month)) AS m")
    m = m.select(F.date_format("m", "yyyy-MM").alias("label"), F.greatest("m", F.lit(start).cast("date")).alias("start"), F.least(F.add_months("m", 1), F.lit(end).cast("date")).alias("stop"))
    return m.where("start < stop").orderBy(F.desc("label"))


def bfs(edges: DataFrame, roots: DataFrame, rounds: int, cap: int) -> DataFrame:
    """edges: (parent, child), roots: (node). (node, depth): every node once, at its least depth, at most so many rounds from a
    root; a round that would go beyond cap visited nodes is the last. Each round is one join with the newest nodes."""
    seen = cut(roots.select("node", F.lit(0).alias("depth")).distinct())
    newest, total = seen, seen.count()
    for depth in range(1, rounds + 1):
        found = edges.join(newest.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node")).distinct()
        newest = cut(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        n = newest.count()
        if not n:
            break
        seen = cut(seen.unionByName(newest))
        total += n
        if total >= cap:
            break
    return seen


def first_hit(candidates: DataFrame, key: str, priority: str, ok: str) -> DataFrame:
    """Of each key the candidate of the least priority number that answers: explicit, then announced, then conventional ones."""
    return candidates.where(F.col(ok)).groupBy(key).agg(F.min_by(F.struct(*[c for c in candidates.columns if c != key]), priority).alias("_c")).select(key, "_c.*")


def date_pages(posts: DataFrame, source: str, date: str, ident: str, per_page: int) -> DataFrame:
    """(source, page, n, cursor, stalled): posts newest first in pages; a page's cursor is its oldest date, before which the next
    page is asked for. A page whose cursor is that of the page before has stalled, and the scan of the source ends there."""
    w = Window.partitionBy(source).orderBy(F.desc(date), F.desc(ident))
    pages = posts.withColumn("page", F.floor((F.row_number().over(w) - 1) / per_page)).groupBy(source, "page").agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("cursor"))
    return pages.withColumn("stalled", F.coalesce(F.lag("cursor").over(Window.partitionBy(source).orderBy("page")) == F.col("cursor"), F.lit(False)))


def archive_start(posts: DataFrame, pinned: DataFrame, source: str, date: str) -> DataFrame:
    """(source, start): the pinned date of a source, else that of its oldest post."""
    oldest = posts.groupBy(source).agg(F.min(date).alias("oldest"))
    return oldest.join(pinned, source, "left").select(source, F.coalesce("pinned", "oldest").alias("start"))


def landed_records(spark: SparkSession, path: str, text_field: str) -> DataFrame | None:
    """Landed files of a public dataset as (text, url); one that can't be opened gives None, so a run goes on without it."""
    try:
        d = spark.read.parquet(path)
    except AnalysisException:
        return None
    url = F.col("url") if dict(d.dtypes).get("url") == "string" else F.lit("")
    text = F.col(text_field) if dict(d.dtypes).get(text_field) == "string" else F.lit(None).cast("string")
    return d.select(text.alias("text"), F.coalesce(url, F.lit("")).alias("url"))


def record_documents(records: DataFrame, text: str, url: str, script: str, least: float = 0.5, words: int = 120, n_lines: int = 3) -> DataFrame:
    """Records as documents: cleaned, behind the quality gate and a least share of a script; adds doc_id, words and ratio."""
    d = once(records.where(TX.strip(F.col(text)) != ""), text, TX.clean(F.col(text)))
    d = d.where(TX.good_document(F.col(text), words, n_lines)).withColumn("ratio", TX.script_ratio(F.col(text), script)).where(F.col("ratio") >= least)
    return d.withColumn("doc_id", TX.content_hash(F.col(text))).withColumn("words", TX.prose_words(F.col(text))).withColumn(url, F.coalesce(F.col(url), F.lit("")))


def page_documents(pages: DataFrame, url: str, text: str, script: str, words: int = 120, n_lines: int = 3, least: float = 0.5) -> DataFrame:
    """Pages with their cleaned text; adds doc_id, words and outcome: kept, failed (no text) or rejected by the url, the quality
    gate or the least share of a script."""
    t = F.col(text)
    kept = wanted(F.col(url)) & TX.good_document(t, words, n_lines) & (TX.script_ratio(t, script) >= least)
    outcome = F.when(kept, "kept").when(F.coalesce(t, F.lit("")) == "", "failed").otherwise("rejected")
    return pages.withColumn("doc_id", TX.content_hash(t)).withColumn("words", TX.prose_words(t)).withColumn("outcome", outcome)


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report of one JSON object; a missing file is one row of nulls, never an error."""
    try:
        d = spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException:
        d = spark.createDataFrame([], schema)
    one = spark.range(1).select(F.lit(True).alias("_one"))
    return one.join(d.withColumn("_one", F.lit(True)), "_one", "left").drop("_one")


def write_stats(stats: DataFrame, path: str) -> None:
    """A small aggregate as one JSON-lines file with its characters as they are."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def write_examples(examples: DataFrame, path: str) -> None:
    """Examples with the fields that are stored; the joined text is not. A failed run leaves no _SUCCESS."""
    kept = ["example_id", "template", "attribute", "n_entities", "hops", "prompt", "answer", "entities"]
    examples.select("split", *kept).write.mode("overwrite").partitionBy("split").json(path)


def log_summary(log: DataFrame, run: str) -> DataFrame:
    """(run, best, best_step, throughput, left): the least validation loss and its first step, the mean of the windows' tokens per
    second without each run's first window, and the seconds that the tokens still to come take at that rate."""
    first = Window.partitionBy(run).orderBy("step")
    d = log.withColumn("_warm", F.row_number().over(first) > 1)
    g = d.groupBy(run).agg(
        F.min("val_loss").alias("best"), F.min_by("step", F.when(F.col("val_loss").isNotNull(), F.struct("val_loss", "step"))).alias("best_step"),
        F.avg(F.when(F.col("_warm"), F.col("tokens_per_second"))).alias("throughput"), F.max("tokens_seen").alias("_seen"), F.max("tokens_total").alias("_total"),
    )
    return g.select(run, "best", "best_step", "throughput", F.try_divide(F.col("_total") - F.col("_seen"), "throughput").alias("left"))


def manifest_totals(files: DataFrame, profile: Column) -> DataFrame:
    """files: (path, bytes). (profile, files, bytes) of those that a profile keeps (null: none), and of all (profile null)."""
    return files.withColumn("profile", profile).where("profile IS NOT NULL").rollup("profile").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
