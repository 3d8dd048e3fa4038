"""Chat formatting in windows of a token budget.

Prefix sums of turn tokens cut a conversation into spans of whole turns. Each span
becomes one training window: the system turn, some of the turns just before the span as
history, and the span's own turns. Only assistant texts of the own turns carry loss, so
every assistant text is a target exactly once.

The template is ``<|role|>`` newline, text, ``<|end|>`` newline. Control strings inside
texts get a backslash after their first character (one more, if there are some), which
is undone by taking one away, so any text comes back unchanged.

Only built-in functions are used. Prefix sums run in blocks of turns first, so one very
long conversation is spread over many tasks; the rows gathered for a window are bounded
by its budget, as every turn counts a few tokens at least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's marks and the role names with a meaning.
TURN_OPEN, ROLE_CLOSE, TURN_CLOSE = "<|", "|>\n", "<|end|>\n"
SYSTEM, TARGET = "system", "assistant"
#: A control string: its first character, backslashes, the rest.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"
ROLE_CODES = (("%", "%25"), ("|", "%7C"), ("\n", "%0A"), ("<", "%3C"))

WINDOW_TOKENS = 1024
HISTORY_TOKENS = 256
#: What a turn's marks count, so that empty turns fill a window too.
TURN_TOKENS = 4
#: Turns are summed in blocks of so many turn numbers before conversations are.
BLOCK_TURNS = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _role_code(role: Column, back: bool = False) -> Column:
    for plain, code in reversed(ROLE_CODES) if back else ROLE_CODES:
        role = F.replace(role, F.lit(code), F.lit(plain)) if back else F.replace(role, F.lit(plain), F.lit(code))
    return role


def _spans(turns: DataFrame, tokens: int) -> DataFrame:
    """Adds each turn's ``before`` (tokens of all earlier turns) and its span ``k``."""
    keys = turns.withColumn("_block", F.floor(F.coalesce("turn", F.lit(0)) / BLOCK_TURNS))
    order = ["turn", "role", "text"]
    inside = Window.partitionBy("conv_id", "_block").orderBy(*order)
    blocks = (
        keys.groupBy("conv_id", "_block")
        .agg(F.sum("tokens").alias("n"), F.count("*").alias("m"))
        .selectExpr(
            "conv_id AS _conv",
            "_block AS _of",
            "sum(n) OVER (PARTITION BY conv_id ORDER BY _block) - n AS _start",
            "sum(m) OVER (PARTITION BY conv_id ORDER BY _block) - m AS _first",
        )
    )
    placed = keys.withColumns(
        {"_upto": F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_row": F.row_number().over(inside)}
    )
    return placed.join(blocks, F.expr("conv_id <=> _conv AND _block = _of")).selectExpr(
        "conv_id",
        "role",
        "text",
        "tokens",
        "_first + _row AS seq",
        "_start + _upto - tokens AS before",
        f"(_start + _upto - tokens) div {tokens} AS k",
    )


def format_chats(
    turns: DataFrame, tokens: int = WINDOW_TOKENS, history: int = HISTORY_TOKENS
) -> DataFrame:
    """Training windows: conv_id, k, formatted, n_repeated, n_turns, loss.

    ``loss`` holds start (from 0) and length, in code points of ``formatted``, of each
    target text. ``n_repeated`` leading turns are the system turn and history.

    ``turns`` has conv_id, turn, role and text; other columns are ignored. NULL text or
    role counts as empty; NULL conv_id is a conversation of its own, and NULL turns come
    first. Turns with equal numbers are ordered by role, then text; repeated rows stay
    repeated. ``tokens`` is a stride: a window has the turns that begin in it, so its last turn
    may reach beyond by all but one of its own tokens, and the system turn and history come
    on top; turns are never cut. The system turn is the
    first turn if its role is ``system``. ``history`` may not exceed ``tokens``, as it
    comes from the span before. An empty table gives no rows.
    """
    if not 0 <= history <= tokens:
        raise ValueError("history must lie between 0 and the tokens of a window")
    text = F.coalesce("text", F.lit(""))
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        text.alias("text"),
        (F.regexp_count(text, F.lit(r"\S+")) + TURN_TOKENS).cast("bigint").alias("tokens"),
    )
    placed = _spans(rows, tokens)
    ends = placed.groupBy("conv_id", "k").agg(F.max(F.expr("before + tokens")).alias("_end"))
    ends = ends.withColumnsRenamed({"conv_id": "_conv", "k": "_k"})
    is_system = F.expr(f"seq = 1 AND role = '{SYSTEM}'")

    own = placed.withColumn("kind", F.lit(2))
    # A span starts where the one before ends, so its history starts that much earlier.
    past = (
        placed.where(~is_system)
        .join(ends, F.expr("conv_id <=> _conv AND k = _k"))
        .where(f"before >= _end - {history}")
        .selectExpr("conv_id", "role", "text", "tokens", "seq", "before", "k + 1 AS k", "1 AS kind")
    )
    head = (
        placed.where(is_system)
        .withColumnRenamed("k", "_own")
        .join(ends, F.expr("conv_id <=> _conv AND _k > _own"))
        .selectExpr("conv_id", "role", "text", "tokens", "seq", "before", "_k AS k", "0 AS kind")
    )
    target = F.expr(f"kind = 2 AND role = '{TARGET}'")
    rendered = (
        own.unionByName(past)
        .unionByName(head)
        .withColumn("_head", F.concat(F.lit(TURN_OPEN), _role_code(F.col("role")), F.lit(ROLE_CLOSE)))
        .withColumn("_body", escape(F.col("text")))
        .withColumn("_turn", F.concat("_head", "_body", F.lit(TURN_CLOSE)))
        .withColumn("_len", F.char_length("_turn").cast("bigint"))
    )
    order = Window.partitionBy("conv_id", "k").orderBy("kind", "seq")
    offset = F.sum("_len").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_len")
    span = F.struct(
        (offset + F.char_length("_head")).alias("start"), F.char_length("_body").cast("bigint").alias("length")
    )
    pieces = rendered.select(
        "conv_id", "k", "kind", F.struct("kind", "seq", "_turn", F.when(target, span).alias("loss")).alias("p")
    )
    return (
        pieces.groupBy("conv_id", "k")
        .agg(
            F.sort_array(F.collect_list("p")).alias("_all"),
            F.count_if(F.col("kind") < 2).alias("n_repeated"),
            F.count_if(F.col("kind") == 2).alias("n_turns"),
        )
        .where("n_turns > 0")
        .selectExpr(
            "conv_id",
            "k",
            "array_join(transform(_all, p -> p._turn), '') AS formatted",
            "n_repeated",
            "n_turns",
            "transform(filter(_all, p -> p.loss IS NOT NULL), p -> p.loss) AS loss",
        )
    )


def read_chats(windows: DataFrame) -> DataFrame:
    """The own turns back from the formatted text alone: conv_id, k, turns, targets.

    ``turns`` are structs of role and text in order; ``targets`` are the texts under
    the loss mask.
    """
    turns = F.slice(
        F.split("formatted", r"<\|end\|>\n"), F.col("n_repeated").cast("int") + 1, F.col("n_turns").cast("int")
    )
    parsed = F.transform(
        turns,
        lambda t: F.struct(
            _role_code(F.regexp_extract(t, r"^<\|([^|]*)\|>\n", 1), back=True).alias("role"),
            unescape(F.regexp_replace(t, r"^<\|[^|]*\|>\n", "")).alias("text"),
        ),
    )
    targets = F.transform(
        "loss",
        lambda s: unescape(
            F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))
        ),
    )
    return windows.select("conv_id", "k", parsed.alias("turns"), targets.alias("targets"), "formatted")


def chat_digest(windows: DataFrame) -> DataFrame:
    """Per conversation, what :func:`read_chats` gives back, as digests."""
    read = read_chats(windows).selectExpr(
        "conv_id",
        "CAST(size(turns) AS BIGINT) AS n",
        "CAST(char_length(formatted) AS BIGINT) AS chars",
        r"struct(k, array_join(transform(turns, t -> t.role || '\n' || t.text || '\n'), '') AS text,"
        " array_join(targets, '') AS loss) AS w",
    )
    return (
        read.groupBy("conv_id")
        .agg(
            F.sum("n").alias("n_turns"),
            F.sum("chars").alias("formatted_chars"),
            F.sort_array(F.collect_list("w")).alias("_w"),
        )
        .selectExpr(
            "conv_id",
            "n_turns",
            "sha2(array_join(_w.text, ''), 256) AS turns_sha256",
            "CAST(char_length(array_join(_w.loss, '')) AS BIGINT) AS loss_chars",
            "sha2(array_join(_w.loss, ''), 256) AS loss_sha256",
            "formatted_chars",
        )
    )
