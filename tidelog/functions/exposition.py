"""Metrics and stats as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape_label(v: Column) -> Column:
    out = F.replace(v, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


def number(v: Column) -> Column:
    """A sample's value: whole numbers plainly, others with all digits."""
    plain = F.when((v == F.floor(v)) & (F.abs(v) < 1e15), F.format_string("%d", v.cast("bigint"))).otherwise(v.cast("string"))
    return F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf").otherwise(plain)


def prometheus(metrics: DataFrame) -> DataFrame:
    """(ord, line) of (name, labels, type, value[, help]): families by name, HELP and TYPE before their samples.

    ``ord`` sorts the lines; one partition per family is enough, and no family is collected.
    """
    about = F.col("help") if "help" in metrics.columns else F.lit("")
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escape_label(e["value"]), F.lit('"')))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    samples = metrics.select("name", F.lit(2).alias("part"), labels.alias("labels"), F.concat("name", labels, F.lit(" "), number(F.col("value"))).alias("line"))
    families = metrics.select("name", "type", about.alias("help")).groupBy("name", "type").agg(F.min("help").alias("help"))
    heads = families.select("name", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.concat(F.lit("# HELP "), "name", F.lit(" "), "help").alias("line")), F.struct(F.lit(1).alias("part"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "type").alias("line")))).alias("r")).select("name", "r.part", F.lit("").alias("labels"), "r.line")
    return heads.unionByName(samples).select(F.struct("name", "part", "labels").alias("ord"), "line")


def human_bytes(n: Column) -> Column:
    mb, kb = 1024.0 * 1024, 1024.0  # whole bytes, then KiB, then MiB
    return F.when(n >= 1 << 20, F.format_string("%.2f MiB", n / mb)).when(n >= 1024, F.format_string("%.1f KiB", n / kb)).otherwise(F.format_string("%d B", n))


def floor_figures(v: Column, figures: int) -> Column:
    """Rounded down to so many significant figures."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(v)) - (figures - 1))
    return F.when(v <= 0, F.lit(0.0)).otherwise(F.floor(v / unit) * unit)


def stats_text(stats: dict, amplification: float) -> str:
    """A table of levels, then write amplification and stalls."""
    mb = lambda n: n / (1 << 20)
    lines = [f"{'level':>5} {'files':>6} {'MB':>9}"]
    lines += [f"{x['level']:>5} {x['files']:>6} {mb(x['bytes']):>9.2f}" for x in stats["levels"] if x["files"]]
    lines.append(f"write amplification {amplification:.2f}: user {mb(stats['user_bytes']):.1f} MB, log {mb(stats['wal_bytes']):.1f} MB, flush {mb(stats['flush_bytes_written']):.1f} MB, compaction {mb(stats['compaction_bytes_written']):.1f} MB")
    lines.append(f"write stalls {stats['stall_count']}, {stats['stall_micros'] / 1000:.1f} ms")
    return "\n".join(lines) + "\n"


def human_micros(x: Column) -> Column:
    return F.when(x >= 1e6, F.format_string("%.1f s", x / 1e6)).when(x >= 1000, F.format_string("%.2f ms", x / 1000)).when(x < 100, F.format_string("%.1f \u00b5s", x)).otherwise(F.format_string("%.0f \u00b5s", x))
