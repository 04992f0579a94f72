"""Text formats: matrices, run logs, geometry files, pulse logs and configurations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOG_COLUMNS = (
    "it_in it_out ereal efourier fcfo sup_size beta threshold algorithm d_ereal d_sup_size blur_radius int_cum_fluct object_area phase_rel_err sol_corr phase_blur d_rho iter_per_s"
).split()


def parse_log(lines: DataFrame) -> DataFrame:
    """lines(value): rows that begin with a digit, their numeric fields in the order of LOG_COLUMNS; comments and legends go."""
    x = lines.where(F.col("value").rlike(r"^\s*\d")).withColumn("f", F.filter(F.transform(F.split(F.trim("value"), r"\s+"), lambda v: v.try_cast("double")), lambda v: v.isNotNull()))
    return x.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(LOG_COLUMNS)])


def parse_legends(lines: DataFrame) -> DataFrame:
    at = F.regexp_extract("value", r'^@\s*s(\d+)\s+legend\s+"([^"]*)"', 1)
    return lines.where(at != "").select(at.cast("int").alias("column"), F.regexp_extract("value", r'legend\s+"([^"]*)"', 1).alias("legend"))


def read_matrices(spark, path: str) -> DataFrame:
    """Whitespace-separated matrices, one file each, as a pixel table: line and place give y and x; mask is 1."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.posexplode(F.split(F.trim("value"), r"\n")).alias("y", "line"))
    p = t.select("name", "y", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("x", "v")).where("v <> ''")
    return p.select("name", "x", "y", F.lit(0).alias("z"), F.col("v").try_cast("double").alias("re"), F.lit(0.0).alias("im"), F.lit(1).alias("mask"))


def read_geometry(spark, path: str) -> DataFrame:
    """Positioned images, from `key: value` lines; each Identifier begins a block. A file is one small text."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\n")).alias("n", "line"))
    kv = t.select("file", "n", F.lower(F.regexp_extract("line", r"^\s*([A-Za-z]+)\s*[:=]", 1)).alias("k"), F.trim(F.regexp_extract("line", r"[:=]\s*(.*)$", 1)).alias("v"))
    block = F.sum(F.when(F.col("k") == "identifier", 1).otherwise(0)).over(Window.partitionBy("file").orderBy("n"))
    rows = kv.withColumn("block", block).where("block > 0").groupBy("file", "block").agg(*[F.max(F.when(F.col("k") == c, F.col("v"))).alias(c) for c in ("identifier", "dx", "dy", "dz", "theta")])
    return rows.select("file", F.col("identifier").alias("id"), *[F.col(c).try_cast("double").alias(c) for c in ("dx", "dy", "dz", "theta")])


def read_master(spark, path: str) -> DataFrame:
    """name, ts, seq of a master log's pulses: lines that begin with FEL hold a name, a date, a time, three words and a stamp."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("seq", "line")).where(F.col("line").startswith("FEL"))
    shape = r"^(FEL\S*?),?\s+\S+,\s*\S+,\s*\S+\s+\S+\s+\S+\s+(\d+)"
    return t.select(F.regexp_extract("line", shape, 1).alias("name"), F.regexp_extract("line", shape, 2).try_cast("int").alias("ts"), "seq").where("ts is not null")


def read_shots(spark, path: str) -> DataFrame:
    """ts, tunnel, hall, seq of a comma-separated list of shots: a stamp, a date, a time, two numbers, and then two pairs of which the second numbers are taken."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("seq", "line"))
    f = F.split("line", r"\s*,\s*")
    return t.select(F.get(f, F.lit(0)).try_cast("int").alias("ts"), F.get(f, F.lit(6)).try_cast("double").alias("tunnel"), F.get(f, F.lit(8)).try_cast("double").alias("hall"), "seq").where("ts is not null")


def pulses(master: DataFrame, shots: DataFrame) -> DataFrame:
    """master(name, ts, seq) and shots(ts, tunnel, hall, seq): equal stamps are consumed in order; pulses without a shot keep nulls."""
    k = F.row_number().over(Window.partitionBy("ts").orderBy("seq"))
    return master.withColumn("k", k).join(shots.withColumn("k", k).drop("seq"), ["ts", "k"], "left").drop("k")


_TOKEN = re.compile(r'\s+|#[^\n]*|//[^\n]*|/\*.*?\*/|(?P<string>"(?:\\.|[^"\\])*")|(?P<name>[A-Za-z*][-\w*]*)|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?L?)|(?P<mark>[={}()\[\],;:])', re.S)


def parse_config(text: str) -> dict:
    """A configuration of groups {}, arrays [], lists () and settings `name = value;`, with comments."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at : at + 20]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else ("end", "")

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1] if at <= len(tokens) else ("end", "")

    def value():
        kind, word = take()
        if kind == "string":
            return re.sub(r"\\(.)", r"\1", word[1:-1])
        if kind == "number":
            return int(word.rstrip("L")) if re.fullmatch(r"[-+]?\d+L?", word) else float(word)
        if kind == "name":
            if word.lower() in ("true", "false"):
                return word.lower() == "true"
            raise ValueError(f"no value: {word}")
        if word == "{":
            return settings("}")
        if word in "[(":
            out, end = [], "]" if word == "[" else ")"
            while peek()[1] != end:
                out.append(value())
                if peek()[1] == ",":
                    take()
                elif peek()[0] == "end":
                    raise ValueError(f"{end!r} is missing")
            take()
            return out
        raise ValueError(f"no value: {word!r}")

    def settings(end):
        out = {}
        while peek()[1] != end:
            kind, name = take()
            if kind != "name":
                raise ValueError(f"a name is expected, not {name!r}" if kind != "end" else f"{end!r} is missing")
            if take()[1] not in "=:":
                raise ValueError(f"= is expected after {name}")
            out[name] = value()
            if peek()[1] in (";", ","):
                take()
        take()
        return out

    tokens.append(("mark", "\0"))
    return settings("\0")


def parse_value(text: str):
    """A value as a configuration holds it; what can't be read is a string."""
    try:
        return parse_config(f"v = {text};")["v"]
    except (ValueError, KeyError):
        return text


def write_config(options: dict) -> str:
    """The text of parse_config; maps ((k, v), ...) become a list of keys and values."""

    def show(v):
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
        if isinstance(v, dict):
            return "{ " + " ".join(f"{k} = {show(x)};" for k, x in v.items()) + " }"
        if isinstance(v, (list, tuple)):
            return "( " + ", ".join(map(show, v)) + " )"
        return repr(v)

    return "".join(f"{k} = {show(v)};\n" for k, v in options.items())
