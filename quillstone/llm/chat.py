"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns are ordered by turn (then role and text). A turn's tokens are the runs of non-space in its text and OVERHEAD for the
template's marks and the role; they are summed up before each turn. A turn whose sum before it lies in [k * step, (k + 1) *
step) is new in window k, where step is half of the budget less the history's and the system turn's tokens; so a window of
turns of at most `step` tokens keeps the budget. A longer turn is never cut: its window is flagged as over the budget. A
window holds the leading system turn (retained in every window if it has at most SYSTEM_SHARE of the budget, else only in
the first), then the turns of the window before that lie within the last HISTORY tokens before its first new turn, then
its new turns. The loss mask covers the texts of new assistant turns; repeated ones are outside it, so each is a target
once. Repetition is bounded: a window repeats at most SYSTEM_SHARE of the budget and HISTORY, and begins `step` tokens after
the one before or later.

All turns of a conversation meet in one task, as its result is one row.

Template: <|turn|>role<|text|>text<|end|> for each turn. Inside roles and texts a backslash is doubled and a backslash and
a full stop are put after the first character of every control string, which `unescape` takes back.

Defined results: a null text or role is empty; a null turn comes first; repeated rows are turns of their own; rows with a
null conversation id form one conversation; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BUDGET, HISTORY, SYSTEM_SHARE, OVERHEAD = 512, 96, 0.5, 4
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What must not occur inside a turn as it stands. Each is broken after its first character.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
SPACES = r"[^\x20\x09-\x0D]+"


def escape(col):
    col = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        col = F.replace(col, F.lit(c), F.lit(f"{c[0]}\\.{c[1:]}"))
    return col


def unescape(col):
    return F.regexp_replace(col, r"\\(?:(\\)|\.)", "$1")


def windows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Per window: conv_id, window, formatted, n_repeated (leading turns that are not new), mask (array of start and length in characters of `formatted`), n_tokens, over_budget."""
    empty = F.lit("")
    turns = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text")
    ).withColumn("tokens", F.regexp_count("text", F.lit(SPACES)).cast("long") + OVERHEAD)
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = turns.select("*", F.row_number().over(order).alias("n"), before.alias("start"))
    is_system = (F.col("n") == 1) & (F.col("role") == "system") & (F.col("tokens") <= int(budget * SYSTEM_SHARE))
    held = F.first(F.when(is_system, F.struct("text", "tokens")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    step = F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.coalesce(F.col("held.tokens"), F.lit(0))) / 2))
    placed = numbered.withColumn("held", held).withColumn("window", F.floor(F.col("start") / step))
    by_window = conv.orderBy("window")
    placed = placed.withColumn("next_start", F.min("start").over(by_window.rangeBetween(1, 1))).withColumn("opens", F.row_number().over(Window.partitionBy("conv_id", "window").orderBy("n")) == 1)

    def piece(window, place, role, text, tokens, new):
        return F.struct(window.alias("window"), place.cast("long").alias("place"), role.alias("role"), text.alias("text"), tokens.alias("tokens"), F.lit(new).alias("new"))

    is_held = F.col("held").isNotNull()
    pieces = F.array_compact(
        F.array(
            piece(F.col("window"), F.col("n"), F.col("role"), F.col("text"), F.col("tokens"), True),
            F.when((F.col("start") >= F.col("next_start") - history) & ~(is_held & (F.col("n") == 1)), piece(F.col("window") + 1, F.col("n"), F.col("role"), F.col("text"), F.col("tokens"), False)),
            F.when(F.col("opens") & is_held & (F.col("window") > 0), piece(F.col("window"), F.lit(0), F.lit("system"), F.col("held.text"), F.col("held.tokens"), False)),
        )
    )
    parts = placed.select("conv_id", F.explode(pieces).alias("p")).select("conv_id", "p.*").withColumn("text", escape(F.col("text"))).withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)))
    inside = Window.partitionBy("conv_id", "window").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("text") + len(END)
    parts = parts.withColumn("at", F.coalesce(F.sum(size).over(inside), F.lit(0)) + F.length("head"))
    row = F.struct("place", F.concat("head", "text", F.lit(END)).alias("out"), "new", F.when(F.col("new") & (F.col("role") == "assistant"), F.struct(F.col("at").alias("start"), F.length("text").cast("long").alias("length"))).alias("loss"))
    rows = parts.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.sum("tokens").alias("n_tokens"))
    return rows.select(
        "conv_id",
        "window",
        F.array_join(F.col("rows.out"), "").alias("formatted"),
        F.size(F.filter("rows", lambda x: ~x["new"])).cast("long").alias("n_repeated"),
        F.array_compact(F.col("rows.loss")).alias("mask"),
        "n_tokens",
        (F.col("n_tokens") > budget).alias("over_budget"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: its turns and the text under the mask, unescaped."""
    said = F.slice(F.split("formatted", r"<\|end\|>", -1), F.col("n_repeated").cast("int") + 1, F.greatest(F.lit(0), F.size(F.split("formatted", r"<\|end\|>", -1)) - 1 - F.col("n_repeated").cast("int")))
    turns = F.transform(said, lambda x: F.concat(unescape(F.substring_index(F.substring(x, len(TURN) + 1, 1 << 30), TEXT, 1)), F.lit("\n"), unescape(F.substring_index(x, TEXT, -1)), F.lit("\n")))
    target = F.transform("mask", lambda m: unescape(F.col("formatted").substr((m["start"] + 1).cast("int"), m["length"].cast("int"))))
    each = formatted.select("conv_id", "window", F.length("formatted").alias("chars"), F.size(said).cast("long").alias("n"), F.array_join(turns, "").alias("turns"), F.array_join(target, "").alias("loss"), "over_budget")
    whole = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"), F.count_if("over_budget").alias("n_over_budget"))
    return whole.select("conv_id", "n_turns", F.array_join("w.turns", "").alias("turns"), F.array_join("w.loss", "").alias("loss"), F.col("formatted_chars").cast("long").alias("formatted_chars"), "n_windows", "n_over_budget")


def op6_chat(spark, sf_dir):
    rows = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    read = read_back(windows(rows.unionByName(extra)))
    return read.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_windows", "n_over_budget")


def _escaped(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        x = f"replace({x}, '{c}', '{c[0]}\\.{c[1:]}')"
    return x


ORACLE_SQL = {
    "op6_chat": f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, row_number() OVER o AS n, len(regexp_extract_all(text, '{SPACES}')) + {OVERHEAD} AS tokens,
             length({_escaped('role')}) + length({_escaped('text')}) + {len(TURN + TEXT + END)} AS size
      FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT conv_id, tokens AS held, size AS held_size FROM t WHERE n = 1 AND role = 'system' AND tokens <= {int(BUDGET * SYSTEM_SHARE)}),
p AS (SELECT t.*, held, held_size, CAST(coalesce(sum(tokens) OVER (PARTITION BY t.conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM t LEFT JOIN s USING (conv_id)),
w AS (SELECT *, CAST(floor(start / greatest(1, floor(({BUDGET - HISTORY} - coalesce(held, 0)) / 2))) AS BIGINT) AS win FROM p),
f AS (SELECT conv_id, win, min(start) AS opened, max(held_size) AS held_size, sum(tokens) AS new, max(held) AS held FROM w GROUP BY ALL),
c AS (SELECT conv_id, sum(size) AS chars FROM w GROUP BY conv_id),
b AS (SELECT w.conv_id, f.win, sum(w.size) AS chars, sum(w.tokens) AS tokens FROM w JOIN f ON w.conv_id = f.conv_id AND f.win = w.win + 1
      WHERE w.start >= f.opened - {HISTORY} AND NOT (w.held IS NOT NULL AND w.n = 1) GROUP BY ALL),
h AS (SELECT conv_id, sum(chars) AS chars FROM b GROUP BY conv_id),
o AS (SELECT f.conv_id, count(*) AS n_windows, count(*) FILTER (new + coalesce(b.tokens, 0) + CASE WHEN f.win > 0 THEN coalesce(held, 0) ELSE 0 END > {BUDGET}) AS n_over_budget
      FROM f LEFT JOIN b ON f.conv_id = b.conv_id AND f.win = b.win GROUP BY f.conv_id),
k AS (SELECT conv_id, sum(held_size) AS chars FROM f WHERE win > 0 GROUP BY conv_id),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS turns,
             coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '') AS loss FROM t GROUP BY conv_id)
SELECT a.conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(c.chars + coalesce(h.chars, 0) + coalesce(k.chars, 0) AS BIGINT) AS formatted_chars, n_windows, n_over_budget
FROM a JOIN c USING (conv_id) JOIN o USING (conv_id) LEFT JOIN h USING (conv_id) LEFT JOIN k USING (conv_id)"""
}
