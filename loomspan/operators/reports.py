"""Evaluation reports: parsing, classification, selection, pivots, and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.time import subtitle_clock

#: Fixed format of a metric table: sizes that end a model's name, and the cells of a row with their units.
SIZES = ("tiny", "small", "medium")
FIELDS = (("cer_raw", "double", "%"), ("cer", "double", "%"), ("sub", "long", ""), ("dele", "long", ""), ("ins", "long", ""), ("sec", "double", "s"), ("speed", "double", "x"))
#: Fixed places of the cells of a threshold table, and of a quantile table behind its label.
SWEEP_CELLS = (("t", 1), ("flagged", 2), ("caught", 3), ("precision", 6), ("recall", 7), ("f1", 8))
QUANTILE_CELLS = (("low", 2), ("p25", 3), ("median", 4), ("high", 5))


#: Conditions of a grid, at most: its list is broadcast.
CONDITIONS = 10_000


def _cells(line: Column) -> Column:
    """Cells of a table row, trimmed, emphasis left out; what precedes the first bar is cell 0."""
    return F.transform(F.split(F.replace(line, F.lit("**"), F.lit("")), "[|]"), lambda x: F.trim(x))


def _number(cells: Column, place: int, kind: str = "double", unit: str = "") -> Column:
    """A cell that is a plain number followed by its unit; null where it isn't."""
    cell = F.get(cells, F.lit(place))
    bare = F.substring_index(cell, unit, 1) if unit else cell
    plain = F.translate(bare, "0123456789.", "") == ""
    return F.when((F.concat(bare, F.lit(unit)) == cell) & plain, bare.try_cast(kind))


def _table_rows(text: Column, cells: tuple[tuple[str, int], ...]) -> Column:
    """Rows of a text whose cells at these places are all numbers: array of (label, numbers)."""
    rows = F.transform(F.split(text, "\n"), _cells)
    found = F.transform(rows, lambda r: F.struct(F.get(r, F.lit(1)).alias("label"), F.struct(*(_number(r, k).alias(c) for c, k in cells)).alias("v")))
    complete = lambda x: F.forall(F.array(*(x["v"][c] for c, _ in cells)), lambda v: v.isNotNull())
    return F.filter(found, complete)


def parse_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Metric rows of report lines; of rows that repeat a model within a report the last stays. Columns: ``name`` and the cells; the model is the size that ends the first cell."""
    cells = _cells(F.col(line))
    numbers = [_number(cells, k, kind, unit).alias(c) for k, (c, kind, unit) in enumerate(FIELDS, 2)]
    rows = lines.where(F.col(line).startswith("|")).select("name", "line_no", F.substring_index(F.get(cells, F.lit(1)), "-", -1).alias("model"), *numbers)
    rows = rows.where(F.col("model").isin(*SIZES)).dropna(subset=[c for c, *_ in FIELDS])
    last = F.row_number().over(Window.partitionBy("name", "model").orderBy(F.desc("line_no")))
    return rows.withColumn("r", last).where("r = 1").drop("r", "line_no")


def parse_sweep(text: Column) -> Column:
    """Rows of a threshold table: array of (t, flagged, caught, precision, recall, f1), by threshold. Emphasis is ignored."""
    return F.array_sort(F.transform(_table_rows(text, SWEEP_CELLS), lambda x: x["v"]))


def parse_quantiles(text: Column, labels: tuple[str, str]) -> Column:
    """Rows of a quantile table by label: map from label to (low, p25, median, high); the last of equal labels stays."""
    named = F.transform(_table_rows(text, QUANTILE_CELLS), lambda x: F.struct(F.coalesce(*(F.when(x["label"].startswith(s), F.lit(s)) for s in labels)).alias("label"), x["v"].alias("v")))
    # entries in reverse: the first of equal labels is the last of the text
    last = lambda s: F.get(F.filter(F.reverse(named), lambda x: x["label"] == s), F.lit(0))
    return F.map_from_entries(F.filter(F.array(*(last(s) for s in labels)), lambda x: x.isNotNull()))


def parse_workload(text: Column, totals: str) -> Column:
    """Totals (two groups of ``totals``), and what the threshold of the best F1 flags and catches; null where either is missing."""
    rows = parse_sweep(text)
    best = F.element_at(F.array_sort(F.transform(rows, lambda r: F.struct((-r["f1"]).alias("o"), r["t"].alias("t"), r["flagged"].alias("flagged"), r["caught"].alias("caught")))), 1)
    total = F.regexp_extract(text, totals, 1)
    return F.when((F.size(rows) > 0) & (total != ""), F.struct(best["t"].alias("threshold"), total.cast("long").alias("total"), F.regexp_extract(text, totals, 2).cast("long").alias("with_error"), best["flagged"].cast("long").alias("flagged"), best["caught"].cast("long").alias("caught")))


def classify(name: Column, speakers: list[str], conditions: list[tuple[str, str]]) -> Column:
    """(speaker, cond, author) from ``<stamp>_<speaker><tail>[__author].md``; nulls where nothing fits. The tail must match whole; first match wins."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^\d{8}-\d{4,6}_", ""), r"\.md$", "")
    author = F.when(stem.contains("__"), F.regexp_extract(stem, r"__((?:(?!__).)*)$", 1))
    body = F.regexp_replace(stem, r"__(?:(?!__).)*$", "")
    found = F.lit(None).cast("struct<speaker: string, cond: string>")
    for s in reversed(speakers):
        for tail, label in reversed(conditions):
            found = F.when(body == s + tail, F.struct(F.lit(s).alias("speaker"), F.lit(label).alias("cond"))).otherwise(found)
    ok = name.endswith(".md") & found.isNotNull()
    return F.struct(F.when(ok, found["speaker"]).alias("speaker"), F.when(ok, found["cond"]).alias("cond"), F.when(ok, author).alias("author"))


def latest_reports(rows: DataFrame) -> DataFrame:
    """Rows of the report that counts for each speaker and condition: the one with most models, of equals the greatest name."""
    n = rows.groupBy("speaker", "cond", "name").agg(F.count_distinct("model").alias("n"))
    best = n.groupBy("speaker", "cond").agg(F.max(F.struct("n", "name")).alias("m")).select("speaker", "cond", F.col("m.name").alias("name"))
    return rows.join(best, ["speaker", "cond", "name"])


def stability(rows: DataFrame) -> DataFrame:
    """Range of the error rate of each model and condition over speakers."""
    return rows.groupBy("cond", "model").agg(F.bround(F.max("cer") - F.min("cer"), 6).alias("range"), F.count("*").alias("n"))


def speaker_matrix(rows: DataFrame, model: str, conditions: list[str], complete: bool = False) -> DataFrame:
    """Speakers by conditions; with ``complete`` only speakers that have all."""
    out = rows.where(F.col("model") == model).groupBy("speaker").pivot("cond", conditions).agg(F.max("cer"))
    return out.dropna(subset=conditions) if complete else out


def error_composition(rows: DataFrame) -> DataFrame:
    """Substitutions, deletions and insertions of each condition and model, one row a kind."""
    g = rows.groupBy("cond", "model").agg(F.sum("sub").alias("sub"), F.sum("dele").alias("dele"), F.sum("ins").alias("ins"))
    return g.unpivot(["cond", "model"], ["sub", "dele", "ins"], "kind", "n")


def provenance(rows: DataFrame) -> DataFrame:
    return rows.groupBy("speaker").agg(F.array_join(F.array_sort(F.collect_set("author")), ",").alias("authors"), F.min("name").alias("earliest"))


def totals(rows: DataFrame) -> DataFrame:
    """Sums by model and speaker, by model, and over all; nulls stand for all."""
    g = rows.groupingSets([["model", "speaker"], ["model"], []], "model", "speaker") if hasattr(rows, "groupingSets") else rows.rollup("model", "speaker")
    return g.agg(F.count("*").alias("n"), F.sum("sub").alias("sub"), F.bround(F.sum("sec"), 4).alias("sec"))


def grid(rows: DataFrame) -> DataFrame:
    """Every speaker with every condition, the mean rate where there is one. Conditions are a short list of at most ``CONDITIONS``; speakers may be many."""
    conds = rows.select("cond").distinct().limit(CONDITIONS + 1)
    mean = rows.groupBy("speaker", "cond").agg(F.bround(F.avg("cer"), 6).alias("cer"))
    listed = conds.agg(F.collect_list("cond").alias("conds"), F.assert_true(F.count("*") <= CONDITIONS, F.lit("too many conditions")).alias("ok"))
    every = rows.select("speaker").distinct().crossJoin(F.broadcast(listed)).where("ok is null").select("speaker", F.explode("conds").alias("cond"))
    return every.join(mean, ["speaker", "cond"], "left")


def subtitles(segments: DataFrame, flag: str = "") -> DataFrame:
    """Subtitle text of each recording: ordinal, times, text with a mark where ``flagged``."""
    w = Window.partitionBy("rec_id").orderBy("seg_no")
    n = F.row_number().over(w)
    text = F.concat(F.when(F.col("flagged"), F.lit(flag)).otherwise(F.lit("")), F.trim("text"))
    one = F.concat(n.cast("string"), F.lit("\n"), subtitle_clock(F.col("start")), F.lit(" --> "), subtitle_clock(F.col("end")), F.lit("\n"), text, F.lit("\n"))
    numbered = segments.select("rec_id", n.alias("n"), one.alias("entry"))
    return numbered.groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda x: x["entry"]), "\n").alias("srt"))


def report_lines(rows: DataFrame) -> DataFrame:
    """Markdown rows of a report table, by report and model."""
    cell = F.format_string("| %s | %.1f%% | %d | %d | %d | %.1fs | %.1fx |", "model", "cer", "sub", "dele", "ins", "sec", "speed")
    return rows.select("name", "model", cell.alias("line"))


def write_reports(rows: DataFrame, path: str, run_id: str) -> None:
    """Appends a run's lines under ``run_id=...``; readers take the greatest run for the latest."""
    report_lines(rows).withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(path)


def word_records(words: DataFrame) -> DataFrame:
    """Word rows as they are dumped: JSON with probability to 6 and start to 3 places."""
    return words.select("rec_id", "seg_no", "word_no", F.to_json(F.struct("word", F.bround("probability", 6).alias("prob"), F.bround("start", 3).alias("start"), "correct"), {"ignoreNullFields": "false"}).alias("json"))


def write_word_records(words: DataFrame, path: str) -> None:
    words.select("rec_id", "seg_no", "word_no", "word", F.bround("probability", 6).alias("prob"), F.bround("start", 3).alias("start"), "correct").write.mode("overwrite").json(path)


#: Names that a broadcast may hold; beyond them names are joined by shuffle.
ALIASES = 10_000


def resolve_models(asked: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``repo`` to ``asked``: a name with a slash is one already, others are looked up in ``known`` (``alias, repo``).

    An unknown name, or none, gets null (``require_known`` refuses it); an alias that is listed repeatedly means its least repo. Rows that repeat stay.
    """
    aliases = known.where("alias is not null").groupBy("alias").agg(F.min("repo").alias("__repo")).select(F.col("alias").alias("__alias"), "__repo")
    if aliases.limit(ALIASES + 1).count() <= ALIASES:
        aliases = F.broadcast(aliases)
    found = asked.join(aliases, F.when(~F.contains(F.col(name), F.lit("/")), F.col(name)) == F.col("__alias"), "left")
    return found.withColumn("repo", F.when(F.contains(F.col(name), F.lit("/")), F.col(name)).otherwise(F.col("__repo"))).drop("__alias", "__repo")


def require_known(resolved: DataFrame, name: str = "name") -> DataFrame:
    """Fails on the first name that has no repo."""
    return resolved.withColumn("repo", F.coalesce("repo", F.raise_error(F.concat(F.lit("unknown model "), F.coalesce(F.col(name), F.lit("null"))))))


def run_options(asked: DataFrame) -> DataFrame:
    """Settles options of many runs, one row each (``threshold, has_reference, device, compute_type, multilingual, language``).

    Adds ``effective_threshold`` (0.70 where a reference comes without one), ``effective_language`` (English where the model knows no other) and
    ``problem``: what is wrong, or null. The same rules as ``params`` has for a single run; null flags are no.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    threshold = F.coalesce("threshold", F.when(yes("has_reference"), F.lit(0.70)))
    problem = F.when((threshold <= 0) | (threshold >= 1) | F.isnan(threshold), F.lit("threshold must lie between 0 and 1")).when((F.col("device") == "cpu") & (F.col("compute_type") == "float16"), F.lit("float16 is not available on cpu"))
    return asked.select("*", threshold.alias("effective_threshold"), F.when(yes("multilingual"), F.col("language")).otherwise(F.lit("en")).alias("effective_language"), problem.alias("problem"))
