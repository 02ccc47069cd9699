"""Writing results: tables, labels, reports and blind labelling samples."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwell.operators.labelling import ASPECT


def write_tables(result, folder: str, form: str = "csv") -> list[str]:
    """Every available table in ``folder``, and ``summary.json`` with the key figures; aggregates only, never texts."""
    written = []
    for name, t in result.tables.items():
        if t.available:
            target = f"{folder}/{name.replace(':', '__')}"
            writer = t.frame().coalesce(1).write.mode("overwrite")  # aggregated tables
            writer.csv(target, header=True) if form == "csv" else writer.format(form).save(target)
            written.append(name)
    figures = {k: v.first().asDict() for k, v in result.kpis.items()}  # one row each
    summary = {"kpis": figures, "sampling": result.sampling, "profile": result.profile.name, "tables": {n: {"available": t.available, "reason": t.reason, "basis": t.basis} for n, t in result.tables.items()}}
    result.data.sparkSession.createDataFrame([(json.dumps(summary, default=str, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")
    return written


def save_labels(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Label columns with aspects as JSON."""
    flags = [c for c in df.columns if c.startswith("flag_")]
    df.select("review_id", "sentiment_ai", "primary_topic_ai", "issue_ai", "confidence_ai", F.to_json("aspects_ai").alias("aspects_ai"), *flags, "sample_weight", "label_source").write.mode(mode).parquet(path)


def load_labels(df: DataFrame, path: str) -> DataFrame:
    """Join saved labels to reviews; what has none is ``not_sampled`` or ``no_text``."""
    saved = df.sparkSession.read.parquet(path).withColumn("aspects_ai", F.from_json("aspects_ai", f"array<{ASPECT}>"))
    return df.join(saved, "review_id", "left").withColumn("label_source", F.coalesce("label_source", F.when(F.col("has_text"), "not_sampled").otherwise("no_text")))


def cache_key(model: str, version: str, fingerprint: str, text: str = "analysis_text"):
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(version), F.lit(fingerprint), F.col(text)), 256)


def path_exists(spark, path: str) -> bool:
    """Whether Spark's file system has the path, wherever it is stored."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def read_cache(spark, path: str) -> DataFrame:
    """Label cache lines (key, label, run); unreadable lines are skipped."""
    return spark.read.schema("key string, label string, run string, _corrupt_record string").json(path).filter("key is not null and label is not null").select("key", "label", "run")


def put_cache(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def labelling_sample(df: DataFrame, path: str, n: int, seed: int, flags: tuple[str, ...] = (), force: bool = False) -> DataFrame:
    """A blind sample to label by hand; a folder that already holds labels is not overwritten."""
    spark = df.sparkSession
    if not force and path_exists(spark, path):
        found = spark.read.csv(path, header=True)
        if "true_sentiment" in found.columns and not found.filter("coalesce(true_sentiment, '') <> ''").isEmpty():
            raise FileExistsError(f"{path} holds labels")
    empty = ["true_sentiment", "true_topic", "true_issues", "true_praise_topics", *(f"true_{f}" for f in flags)]
    out = df.filter("has_text").orderBy(F.xxhash64("review_id", F.lit(seed)), "review_id").limit(n).select("review_id", "analysis_text", *[F.lit("").alias(c) for c in empty])
    out.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return out


def labelling_guide(profile) -> str:
    """What someone who labels by hand has to know, in Markdown."""
    lines = ["# Labelling guide", "", "Judge the text alone, not the stars. `true_sentiment` is Positive, Neutral or Negative; `true_topic` is the one topic that the text is most about.", "", "`true_issues` holds every complaint and `true_praise_topics` every praised topic, between semicolons; leave them blank if there is none.", "", "## Topics and issues", ""]
    for topic, issues in profile.taxonomy.items():
        lines += [f"* **{topic}**", *(f"    * {i}: {d}" for i, d in issues.items())]
    if profile.flags:
        lines += ["", "## Yes or no", "", *(f"* `true_{f}`: {d}" for f, d in profile.flags.items())]
    return "\n".join(lines) + "\n"


def markdown_table(df: DataFrame, most: int = 50) -> str:
    rows = [r.asDict() for r in df.limit(most).collect()]
    show = lambda v: "" if v is None else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(show(r[c]) for c in df.columns) + " |" for r in rows)])


def evaluation_report(sections: dict[str, DataFrame], folder: str) -> None:
    """A Markdown report of small tables, with the same as JSON."""
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/report.md", "w", encoding="utf-8") as f:
        f.write("\n\n".join(f"## {k}\n\n{markdown_table(v)}" for k, v in sections.items()) + "\n")
    with open(f"{folder}/report.json", "w", encoding="utf-8") as f:
        json.dump({k: [r.asDict(recursive=True) for r in v.limit(1000).collect()] for k, v in sections.items()}, f, default=str, ensure_ascii=False)
