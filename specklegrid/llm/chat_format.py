"""Chat formatting by rotation of perspectives.

For every participant of a conversation the whole dialogue is rendered with that speaker as the assistant and every
other as a user of its own name, with the spans of characters that are to be learned (the assistant's contents and end
marks). Offsets come from two running sums, one over all turns as if all were users' and one over the speaker's
own, so a dialogue is read once for all its participants and its work grows with its length. DataFrame functions only.

Contents can't forge marks: every `<|` in a text or role gets a second bar (`<||`), and in roles a backslash is
doubled and a line break becomes backslash n.

Cases: a null role is the speaker `unknown`; a null text is empty; a null turn comes first, as turn 0; repeated
turns all stay, ordered by role and text; a very long dialogue is rendered whole like others, one row a speaker; rows
without conv_id belong to no dialogue; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "<|im_start|>assistant\n"


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, speaker (who is the assistant), n_turns, rendered, mask (`start-end` of each learned span of characters, joined by commas)."""
    safe = lambda c, none: F.replace(F.coalesce(c, F.lit(none)), F.lit("<|"), F.lit("<||"))
    line = F.replace(F.replace(safe("role", "unknown"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    t = turns.where("conv_id is not null").select("conv_id", F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), line.alias("role"), safe("text", "").alias("text"))
    t = t.select("*", F.concat(F.lit("<|im_start|>user name="), "role", F.lit("\n")).alias("head"), F.concat("text", F.lit("<|im_end|>")).alias("body"))
    order = ["turn", "role", "text"]
    before = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head").cast("long")
    as_user = F.coalesce(F.sum(size + F.length("body") + 1).over(before("conv_id")), F.lit(0))
    saved = F.coalesce(F.sum(size - len(ASSISTANT)).over(before("conv_id", "role")), F.lit(0))
    t = t.withColumns({"k": F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)), "at": as_user - saved + len(ASSISTANT)})
    span = F.concat("at", F.lit("-"), F.col("at") + F.length("body"))
    whole = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "role", "head", "body", span.alias("span")))).alias("turns"))
    x = whole.select("conv_id", F.explode(F.array_distinct("turns.role")).alias("speaker"), "turns")
    own = lambda r: r["role"] == F.col("speaker")
    rendered = F.concat_ws("", F.transform("turns", lambda r: F.concat(F.when(own(r), F.lit(ASSISTANT)).otherwise(r["head"]), r["body"], F.lit("\n"))))
    mask = F.concat_ws(",", F.transform(F.filter("turns", own), lambda r: r["span"]))
    return x.select("conv_id", "speaker", F.size("turns").cast("long").alias("n_turns"), rendered.alias("rendered"), mask.alias("mask"))


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP2_SQL = """
WITH t AS (SELECT conv_id, coalesce(turn, 0)::BIGINT AS turn, replace(replace(replace(coalesce(role, 'unknown'), '<|', '<||'), '\\', '\\\\'), chr(10), '\\n') AS role,
  replace(coalesce(text, ''), '<|', '<||') AS text FROM conversations WHERE conv_id IS NOT NULL),
who AS (SELECT DISTINCT conv_id, role AS speaker FROM t),
x AS (SELECT t.conv_id, speaker, turn, role, text, role = speaker AS own,
  CASE WHEN role = speaker THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>user name=' || role || chr(10) END AS head, text || '<|im_end|>' AS body FROM t JOIN who USING (conv_id)),
n AS (SELECT *, row_number() OVER w AS k, sum(length(head) + length(body) + 1) OVER w - length(head) - length(body) - 1 AS off
  FROM x WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, speaker, count(*)::BIGINT AS n_turns, string_agg(head || body || chr(10), '' ORDER BY k) AS rendered,
  coalesce(string_agg((off + length(head))::BIGINT::VARCHAR || '-' || (off + length(head) + length(body))::BIGINT::VARCHAR, ',' ORDER BY k) FILTER (WHERE own), '') AS mask
FROM n GROUP BY conv_id, speaker
"""
