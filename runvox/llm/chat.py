"""Chat formatting with budgeted windows, in DataFrame functions only.

Turns get a global order and, with it, prefix sums of their tokens, so a conversation of any length is cut without being
gathered: the stretch of tokens in which a turn starts is its window. A turn longer than a stretch is a window of its
own. Every window repeats the system turn and the turns that fit a limited history before it; what is repeated is not
under the loss mask. A window is the only thing that is gathered, and the budget bounds it (unless a single turn or the
system turn alone exceeds it).

Format: ``### role: text </turn>`` and a line end per turn. In roles and texts, backslash, ``#`` and ``<`` become
``\\b``, ``\\h`` and ``\\l`` (in roles ``:`` becomes ``\\c``), so no text can hold a mark of the format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runvox.llm.tables import word_count
from runvox.scale import materialise, ranked

BUDGET, HISTORY = 1024, 192
_TURN_TOKENS = 4
_OPEN, _COLON, _CLOSE = "### ", ": ", " </turn>\n"
_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))


def _escaped(text: Column, more: tuple = ()) -> Column:
    for plain, code in (*_ESCAPES, *more):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def _plain(text: Column, more: tuple = ()) -> Column:
    for plain, code in reversed((*_ESCAPES, *more)):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


_ROLE = ((":", "\\c"),)


def formatted(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, bucket, long, repeated, text, mask) per window, in the order (bucket, long) within a conversation.

    ``turns``: (conv_id, turn, role, text). ``repeated`` counts the turns at the start that an earlier window has too;
    ``mask`` lists (start, length) in code points of the assistant texts, as they stand, of the other turns. Null roles
    and texts are empty; a null conv_id is a conversation of its own; turns with equal numbers (null first) go by role,
    then text; repeated rows are turns of their own. An empty table gives no windows.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                     F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("tokens", word_count("text") + word_count("role") + _TURN_TOKENS)
    placed = materialise(ranked(t, ["conv_id", "turn", "role", "text"], weight="tokens", into="place"))
    heads = placed.groupBy("conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"),
                                          F.min_by(F.struct("role", "tokens", "text"), "place").alias("head"))
    system = (F.col("head.role") == "system") & (F.col("n") > 1)
    heads = heads.select(F.col("conv_id").alias("_conv"), "first", F.when(system, F.col("head")).alias("system"))
    on = F.col("conv_id").eqNullSafe(F.col("_conv"))
    own = (placed.join(heads.select("_conv", "first", "system.tokens").withColumnRenamed("tokens", "st"), on)
           .where(F.col("st").isNull() | (F.col("place") > F.col("first")))
           .withColumn("st", F.coalesce("st", F.lit(0)))
           .withColumn("stretch", F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.col("st")) / 2)))
           .withColumn("at", F.col("place") - F.col("first") - F.col("st"))
           .withColumn("bucket", F.floor(F.col("at") / F.col("stretch")))
           .withColumn("long", (F.col("tokens") > F.col("stretch")).cast("int"))
           .select("conv_id", "bucket", "long", "stretch", "at", "tokens", "role", "text"))
    own = materialise(own)
    windows = own.groupBy("conv_id", "bucket", "long").agg(F.min("at").alias("begins"))
    w = windows.select(F.col("conv_id").alias("_conv"), F.col("bucket").alias("_b"), F.col("long").alias("_l"), "begins")
    after = F.array(*[F.struct((F.col("bucket") + b).alias("b"), F.lit(n).alias("n")) for b, n in ((0, 1), (1, 0), (1, 1))])
    before = (own.withColumn("to", F.explode(after))
              .join(w, on & (F.col("to.b") == F.col("_b")) & (F.col("to.n") == F.col("_l")))
              .where((F.col("at") + F.col("tokens") <= F.col("begins"))
                     & (F.col("begins") - F.col("at") <= F.least(F.lit(history), F.col("stretch"))))
              .select("conv_id", F.col("_b").alias("bucket"), F.col("_l").alias("long"), F.lit(1).alias("kind"), "at", "role", "text"))
    lead = (windows.join(heads.where("system IS NOT NULL"), on)
            .select("conv_id", "bucket", "long", F.when(F.col("begins") == 0, 0).otherwise(1).alias("seen"),
                    F.lit(-1).cast("long").alias("at"), F.col("system.role").alias("role"), F.col("system.text").alias("text")))
    everything = (own.select("conv_id", "bucket", "long", F.lit(0).alias("seen"), "at", "role", "text")
                  .unionByName(before.withColumnRenamed("kind", "seen")).unionByName(lead))
    piece = F.struct("at", "seen", F.concat(F.lit(_OPEN), _escaped(F.col("role"), _ROLE), F.lit(_COLON)).alias("open"),
                     _escaped(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("target"))
    gathered = everything.groupBy("conv_id", "bucket", "long").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    mask = (f"aggregate(p, named_struct('at', 0, 'm', CAST(array() AS array<struct<start:int,length:int>>)), (a, x) -> named_struct("
            f"'at', a.at + length(x.open) + length(x.body) + {len(_CLOSE)}, 'm', CASE WHEN x.target AND x.seen = 0 THEN "
            f"concat(a.m, array(named_struct('start', a.at + length(x.open), 'length', length(x.body)))) ELSE a.m END), a -> a.m)")
    return gathered.select(
        "conv_id", "bucket", "long", F.expr("size(filter(p, x -> x.seen = 1))").alias("repeated"),
        F.concat_ws("", F.transform("p", lambda x: F.concat(x["open"], x["body"], F.lit(_CLOSE)))).alias("text"),
        F.expr(mask).alias("mask"))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, turns, loss) per conversation: the turns (role, text) of all windows without what is repeated, and the
    unescaped texts under the loss mask, both in order."""
    turns = F.expr("slice(t, repeated + 1, size(t))")
    parts = windows.withColumn("t", F.array_remove(F.split("text", _CLOSE, -1), ""))
    parts = parts.select("conv_id", "bucket", "long", turns.alias("t"),
                         F.transform("mask", lambda m: F.substring(F.col("text"), m["start"] + 1, m["length"])).alias("loss"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "long", "t", "loss"))).alias("w"))
    whole = whole.select("conv_id", F.expr("flatten(transform(w, x -> x.t))").alias("t"),
                         F.expr("flatten(transform(w, x -> x.loss))").alias("loss"))

    def turn(x: Column) -> Column:
        inner = F.substr(x, F.lit(len(_OPEN) + 1))
        role = F.substring_index(inner, _COLON, 1)
        return F.struct(_plain(role, _ROLE).alias("role"), _plain(F.substr(inner, F.length(role) + len(_COLON) + 1)).alias("text"))

    return whole.select("conv_id", F.transform("t", turn).alias("turns"), F.transform("loss", lambda x: _plain(x)).alias("loss"))


def digests(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the windows. The
    digests of a conversation are over one string, so here its texts do come together."""
    windows = materialise(formatted(turns, budget, history))
    sizes = windows.groupBy(F.col("conv_id").alias("_conv")).agg(F.sum(F.length("text")).cast("long").alias("formatted_chars"))
    back = read_back(windows)
    said = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    back = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                       F.concat_ws("", "loss").alias("_loss"))
    back = back.select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"),
                       F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"))
    return back.join(sizes, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
