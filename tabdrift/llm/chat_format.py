"""Preference formatting: shared prompt, two completions, loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markup of a rendered turn, before the role, between role and text, and after the text.
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv and ``turns``, an array of (role, text) in turn order.

    Null roles and texts become empty. Turns with equal numbers stand in order of
    role and text, and repeated turns stay repeated; a null number comes first. Other
    columns are dropped. An empty table gives no conversation. A conversation is one
    record of the output, so its turns meet in one task by design.
    """
    body = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    gathered = turns.groupBy(F.col(conv).alias("conv")).agg(F.array_sort(F.collect_list(body)).alias("t"))
    return gathered.select("conv", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns of ``a`` and ``b`` that agree in role and text."""
    shared = F.least(F.size(a), F.size(b))
    upto = F.slice(a, 1, shared)
    differs = F.transform(upto, lambda x, i: ~x.eqNullSafe(F.get(b, i)))
    first = F.array_position(differs, True)
    return F.when(first > 0, first - 1).otherwise(shared).cast("int")


def _from(turns: Column, start: Column) -> Column:
    return F.slice(turns, start + 1, F.greatest(F.size(turns) - start, F.lit(0)))


def rendered(turns: Column) -> Column:
    head, mid, tail = TEMPLATE
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(head), x["role"], F.lit(mid), x["text"], F.lit(tail))), "")


def loss_spans(turns: Column, trained_role: str) -> Column:
    """Spans (start, end) in characters of the rendered text that carry loss.

    They cover text and closing markup of the turns of ``trained_role``; markup
    before them and all other turns are masked.
    """
    head, mid, tail = TEMPLATE
    body = lambda x: F.length(x["text"]) + F.lit(len(tail))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(done: Column, x: Column) -> Column:
        begin = done["at"] + F.lit(len(head) + len(mid)) + F.length(x["role"])
        end = begin + body(x)
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["role"] == trained_role, F.concat(done["spans"], one)).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def format_preferences(pairs: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Render pairs with arrays ``chosen_turns`` and ``rejected_turns`` of (role, text).

    Adds n_prefix, the length of the longest common turn prefix; prompt, that prefix
    rendered once; chosen and rejected, the rest of either conversation; and
    chosen_spans and rejected_spans, where each completion carries loss. The prompt
    is masked whole. Equal conversations give a full prompt and empty completions, and
    arrays without turns empty texts. A conversation of any length is one row. Repeated rows
    give repeated results. Input columns of the names added are replaced.
    """
    chosen, rejected = F.col("chosen_turns"), F.col("rejected_turns")
    split = pairs.withColumn("n_prefix", common_prefix(chosen, rejected))
    split = split.withColumn("cf_c", _from(chosen, F.col("n_prefix"))).withColumn("cf_r", _from(rejected, F.col("n_prefix")))
    return split.withColumns({
        "prompt": rendered(F.slice(chosen, 1, F.col("n_prefix"))),
        "chosen": rendered(F.col("cf_c")),
        "rejected": rendered(F.col("cf_r")),
        "chosen_spans": loss_spans(F.col("cf_c"), trained_role),
        "rejected_spans": loss_spans(F.col("cf_r"), trained_role),
    }).drop("cf_c", "cf_r")


def pairs_by_swapped_reply(convs: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One pair per conversation: itself against itself with another's last reply.

    The rejected side is the conversation up to its last reply, followed by the
    last reply of its neighbour, the conversation whose integer id differs in the
    lowest bit. Without a reply of its own the neighbour's is put at the end;
    without a neighbour or a reply there, nothing is put. Null ids have no pair.
    """
    roles = F.transform("turns", lambda x: x["role"] == trained_role)
    last = F.size("turns") - F.array_position(F.reverse(roles), True) + 1
    own = convs.filter(F.col("conv").isNotNull()).withColumn("last", F.when(F.array_contains(roles, True), last))
    replies = own.select(F.col("conv").alias("other"), F.get("turns", F.col("last") - 1).alias("reply"))
    stem = F.when(F.col("last").isNull(), F.col("turns")).otherwise(F.slice("turns", 1, F.col("last") - 1))
    swapped = F.when(F.col("reply").isNull(), stem).otherwise(F.array_append(stem, F.col("reply")))
    other = F.col("conv") + 1 - 2 * F.pmod(F.col("conv"), F.lit(2))
    return own.withColumn("other", other).join(replies, "other", "left").select(
        "conv", F.col("turns").alias("chosen_turns"), swapped.alias("rejected_turns")
    )


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


def oracle_sql(trained_role: str = "assistant") -> str:
    head, mid, tail = ("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in TEMPLATE)
    one = f"{head} || role || {mid} || text || {tail}"
    return f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, max(CASE WHEN role = '{trained_role}' THEN i END) AS k, max(i) AS n FROM t GROUP BY conv_id),
r AS (
  SELECT t.conv_id, t.i, t.role, t.text FROM t JOIN last USING (conv_id) WHERE t.i < coalesce(k, n + 1)
  UNION ALL
  SELECT l.conv_id, coalesce(l.k, l.n + 1), o.role, o.text
  FROM last l JOIN last m ON m.conv_id = l.conv_id + 1 - 2 * (((l.conv_id % 2) + 2) % 2)
  JOIN t o ON o.conv_id = m.conv_id AND o.i = m.k),
sides AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.i, r.i) AS i,
         c.role AS crole, c.text AS ctext, r.role AS rrole, r.text AS rtext
  FROM t c FULL JOIN r ON c.conv_id = r.conv_id AND c.i = r.i),
prefix AS (
  SELECT conv_id,
         CAST(coalesce(min(CASE WHEN crole IS NOT DISTINCT FROM rrole AND ctext IS NOT DISTINCT FROM rtext THEN NULL ELSE i END) - 1, max(i)) AS INTEGER) AS n_prefix
  FROM sides GROUP BY 1),
turns AS (
  SELECT p.*, 'c' AS side, t.i, t.role, t.text, {one} AS body FROM prefix p JOIN t USING (conv_id)
  UNION ALL
  SELECT p.*, 'r', r.i, r.role, r.text, {one} FROM prefix p JOIN r USING (conv_id)),
placed AS (
  SELECT *, i > n_prefix AS late,
         coalesce(sum(length(body)) OVER (PARTITION BY conv_id, side, i > n_prefix ORDER BY i
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM turns)
SELECT conv_id, n_prefix,
       coalesce(string_agg(body, '' ORDER BY i) FILTER (side = 'c' AND NOT late), '') AS prompt,
       coalesce(string_agg(body, '' ORDER BY i) FILTER (side = 'c' AND late), '') AS chosen,
       coalesce(string_agg(body, '' ORDER BY i) FILTER (side = 'r' AND late), '') AS rejected,
       coalesce(string_agg(CAST(start + length({head} || role || {mid}) AS BIGINT) || '-' || CAST(start + length(body) AS BIGINT), ',' ORDER BY i)
                FILTER (side = 'c' AND late AND role = '{trained_role}'), '') AS chosen_spans,
       coalesce(string_agg(CAST(start + length({head} || role || {mid}) AS BIGINT) || '-' || CAST(start + length(body) AS BIGINT), ',' ORDER BY i)
                FILTER (side = 'r' AND late AND role = '{trained_role}'), '') AS rejected_spans
FROM placed GROUP BY 1, 2"""
