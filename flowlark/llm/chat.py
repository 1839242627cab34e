"""Preference formatting: a prompt rendered once, and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TURN = "struct<turn:bigint,role:string,text:string>"


def conversations_as_arrays(turns: DataFrame, key: list[str]) -> DataFrame:
    """One row per conversation, with its turns in order (turn, role, text; a null turn comes first).

    Exact repeats of a turn count once; a null role or text counts as empty; rows with a null key go.
    """
    kept = turns.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key))
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return kept.groupBy(*key).agg(F.array_distinct(F.array_sort(F.collect_list(turn))).alias("turns"))


def same_turn(a: Column, b: Column) -> Column:
    return (a["role"] == b["role"]) & (a["text"] == b["text"])


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns have equal role and text."""
    most = F.least(F.size(a), F.size(b))
    steps = F.when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0), lambda n, i: F.when((n == i) & same_turn(F.get(a, i), F.get(b, i)), n + 1).otherwise(n))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n"))), "")


def trained_spans(turns: Column) -> Column:
    """Where in the rendered turns the tokens to learn stand: texts of the assistant with their end mark, as (start, end) in characters."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["role"]) + F.lit(len("<|im_start|>\n"))
        stop = start + F.length(t["text"]) + F.lit(len("<|im_end|>"))
        mine = F.array(F.struct(start.cast("int").alias("start"), stop.cast("int").alias("end")))
        spans = F.when(t["role"] == "assistant", F.concat(state["spans"], mine)).otherwise(state["spans"])
        return F.struct((stop + 1).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, empty, step, lambda s: s["spans"])


def preference_format(pairs: DataFrame) -> DataFrame:
    """pairs: any key columns, with `chosen` and `rejected` arrays of turns (turn, role, text).

    The longest common prefix of turns is rendered once as `prompt`; what follows on each side is a
    completion with the spans that are learnt; all else of it is masked. Equal sides give two empty
    completions and `identical`; a side that is a prefix of the other gives one empty completion; no
    common turn gives an empty prompt. Null or empty sides have no turns. Key columns are passed on;
    columns with the names of results are replaced. Each row is worked out by itself.
    """
    none = F.array().cast(f"array<{TURN}>")
    made = ["n_prompt_turns", "prompt", "chosen_completion", "chosen_spans", "rejected_completion", "rejected_spans", "identical"]
    keys = [c for c in pairs.columns if c not in {"chosen", "rejected", *made}]
    rows = pairs.select(*(F.col(f"`{k}`") for k in keys), F.coalesce("chosen", none).alias("__a"), F.coalesce("rejected", none).alias("__b"))
    rows = rows.withColumn("__n", common_turns(F.col("__a"), F.col("__b")))
    rest = {s: F.slice(F.col(f"__{s}"), F.col("__n") + 1, F.greatest(F.size(f"__{s}") - F.col("__n"), F.lit(0))) for s in "ab"}
    rows = rows.withColumns({"__ra": rest["a"], "__rb": rest["b"], "__p": F.slice("__a", F.lit(1), F.col("__n"))})
    return rows.select(
        *(F.col(f"`{k}`") for k in keys),
        F.col("__n").cast("long").alias("n_prompt_turns"),
        rendered(F.col("__p")).alias("prompt"),
        rendered(F.col("__ra")).alias("chosen_completion"),
        trained_spans(F.col("__ra")).alias("chosen_spans"),
        rendered(F.col("__rb")).alias("rejected_completion"),
        trained_spans(F.col("__rb")).alias("rejected_spans"),
        ((F.size("__ra") == 0) & (F.size("__rb") == 0)).alias("identical"),
    )


def worse_last_reply(turns: Column) -> Column:
    """The conversation up to its last reply, which is replaced by its first reply, or by nothing if that is the same."""
    replies = F.filter(F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    last, first = F.element_at(replies, -1), F.element_at(replies, 1)
    text = F.when(first < last, F.get(turns, first)["text"]).otherwise(F.lit(""))
    swapped = F.struct(F.get(turns, last)["turn"].alias("turn"), F.lit("assistant").alias("role"), text.alias("text"))
    return F.when(F.size(replies) > 0, F.concat(F.slice(turns, F.lit(1), last), F.array(swapped))).otherwise(turns)


def preference_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from a table of conversations (conv_id, turn, role, text).

    `reply`: every conversation against itself with a worse last reply. `opening`: of all that open
    with the same turn, the one with the least conv_id against each other one, so a group of n gives
    n - 1 pairs. The least id is found by a map-side combined minimum, never by gathering a group.
    """
    # Turns are gathered again for each use: a conversation moves by its own id, never by its opening.
    whole = conversations_as_arrays(turns, ["conv_id"]).select(F.col("conv_id").cast("long").alias("conv_id"), "turns")
    first = F.get("turns", F.lit(0))
    heads = whole.select("conv_id", F.sha2(F.concat_ws("\x01", first["role"], first["text"]), 256).alias("opening"))
    shared = heads.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"), F.count("*").alias("n")).where("n > 1")
    links = heads.join(shared, "opening").where("conv_id <> chosen_id").select("chosen_id", F.col("conv_id").alias("rejected_id"))
    right = links.join(whole.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected")), "rejected_id")
    opened = right.join(whole.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen")), "chosen_id")
    own = whole.select(F.lit("reply").alias("kind"), F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), F.col("turns").alias("chosen"), worse_last_reply(F.col("turns")).alias("rejected"))
    return own.unionByName(opened.select(F.lit("opening").alias("kind"), "chosen_id", "rejected_id", "chosen", "rejected"))
