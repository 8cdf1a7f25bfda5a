"""Batches for translation: what is pending, where to cut, prompts, answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuelane.operators import chains
from cuelane.operators.timeline import stamp


def blank(col: str) -> Column:
    return F.trim(F.coalesce(F.col(col), F.lit(""))) == ""


def pending_segments(segments: DataFrame, done: DataFrame) -> DataFrame:
    """Segments with text whose (media_id, seg_idx) is not in done."""
    return segments.where(~blank("text")).join(done.select("media_id", "seg_idx"), ["media_id", "seg_idx"], "left_anti").withColumn("original_index", F.col("seg_idx"))


def untranslated_segments(segments: DataFrame) -> DataFrame:
    return segments.where(~blank("text") & blank("translated_text"))


def synthesis_ready(segments: DataFrame, limit: int | None = None) -> DataFrame:
    """Segments with a translation, numbered by start; with `limit` the first so many of each recording. A blank
    translated_text gives way to translates_text where the table has that column."""
    if "translates_text" in segments.columns:
        segments = segments.withColumn("translated_text", F.when(blank("translated_text"), F.col("translates_text")).otherwise(F.col("translated_text")))
    out = segments.where(~blank("translated_text")).withColumn("rank", F.row_number().over(W.partitionBy("media_id").orderBy("start_ms", "seg_idx")))
    return out if limit is None else out.where(F.col("rank") <= limit)


def merge_translations(segments: DataFrame, done: DataFrame, model: str, pair: str) -> DataFrame:
    """Translations put back by index, missing ones empty."""
    d = done.select("media_id", "seg_idx", F.col("translated_text").alias("__t"))
    return segments.join(d, ["media_id", "seg_idx"], "left").withColumn("translated_text", F.coalesce("__t", F.lit(""))).drop("__t").withColumn("model", F.lit(model)).withColumn("pair", F.lit(pair))


def smart_batches(segments: DataFrame, least: int = 50, most: int = 100, gap: int = 5000) -> DataFrame:
    """Adds batch_id and item (place in the batch, from 1): a cut before the first gap of at least `gap` after `least`
    items, else before the largest gap (the first of equal ones) up to `most`; a rest of `least` or fewer is one batch.

    For each item a window over the next `most` gaps tells where the next cut would be if a batch began there; the cuts
    are the chain of these from the first item, walked through where the items lie. Texts take no part in that; cuts alone
    are dealt to the items. Recordings are not null.
    """
    order = W.partitionBy("media_id").orderBy("start_ms", "seg_idx")
    n = segments.withColumn("__k", F.row_number().over(order).cast("long") - 1)
    by_k = W.partitionBy("media_id").orderBy("k")
    slim = n.select("media_id", F.col("__k").alias("k"), F.count("*").over(W.partitionBy("media_id")).alias("n"), (F.col("start_ms") - F.lag("end_ms").over(order)).alias("gap"))
    ahead = by_k.rowsBetween(least, most - 1)
    first, widest = F.min(F.when(F.col("gap") >= gap, F.col("k"))).over(ahead), F.max(F.struct("gap", (-F.col("k")).alias("before"))).over(ahead)
    cut = F.when(F.col("n") - F.col("k") > least, F.coalesce(F.col("first"), F.when(F.col("k") + most < F.col("n"), F.coalesce(-F.col("widest.before"), F.col("k") + most))))
    points = slim.select("media_id", "k", "n", first.alias("first"), widest.alias("widest")).select("media_id", "k", cut.alias("nxt"))
    marked = n.join(chains.walk(points).select("media_id", F.col("k").alias("__k"), F.lit(1).alias("__cut")), ["media_id", "__k"], "left")
    so_far = W.partitionBy("media_id").orderBy("__k")
    numbered = marked.withColumn("batch_id", (F.count("__cut").over(so_far) - 1).cast("int"))
    return numbered.withColumn("item", (F.col("__k") - F.max(F.when(F.col("__cut") == 1, F.col("__k"))).over(so_far) + 1).cast("int")).select(*segments.columns, "batch_id", "item")


def numbered_prompt(items: DataFrame) -> DataFrame:
    """(media_id, batch_id, n, prompt): '1. text' lines in order of item."""
    lines = F.sort_array(F.collect_list(F.struct("item", "text")))
    return items.groupBy("media_id", "batch_id").agg(F.count("*").alias("n"), F.array_join(F.transform(lines, lambda x: F.concat(x["item"].cast("string"), F.lit(". "), x["text"])), "\n").alias("prompt"))


def timed_prompt(items: DataFrame) -> DataFrame:
    """(media_id, batch_id, n, prompt): 'item. [start – end] text' lines in order of item, texts trimmed and on one line."""
    at = lambda c: stamp(F.col(c), ":", ".")
    line = F.concat(F.col("item").cast("string"), F.lit(". ["), at("start_ms"), F.lit(" – "), at("end_ms"), F.lit("] "), F.replace(F.trim("text"), F.lit("\n"), F.lit(" ")))
    return items.groupBy("media_id", "batch_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))


def subtitle_prompt(entries: DataFrame) -> DataFrame:
    """(media_id, batch_id, prompt): 'id# [start – end] text' lines of the subtitles (ord, entry_id, ...) given to a batch."""
    at = lambda c: stamp(F.col(c), ":", ".")
    line = F.concat(F.col("entry_id").cast("string"), F.lit("# ["), at("start_ms"), F.lit(" – "), at("end_ms"), F.lit("] "), "text")
    return entries.groupBy("media_id", "batch_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))


def parse_numbered_answer(answers: DataFrame) -> DataFrame:
    """(media_id, batch_id, item, line) of answers (n, answer) with exactly n non-blank lines; numbers in front are removed."""
    lines = F.filter(F.split("answer", "\n"), lambda x: F.trim(x) != "")
    good = answers.withColumn("lines", lines).where(F.size("lines") == F.col("n"))
    return good.select("media_id", "batch_id", F.posexplode("lines").alias("p", "l")).select("media_id", "batch_id", (F.col("p") + 1).alias("item"), F.trim(F.regexp_replace(F.trim("l"), "^\\d+\\.\\s*", "")).alias("line"))


def bisect_rejected(items: DataFrame) -> DataFrame:
    """The next round of rejected batches: halves labelled -A and -B (label, item, n); a batch of one has failed for good."""
    half = F.expr("n div 2")
    return items.withColumn("failed", F.col("n") == 1).withColumn("next_label", F.when(F.col("n") == 1, F.col("label")).when(F.col("item") <= half, F.concat("label", F.lit("-A"))).otherwise(F.concat("label", F.lit("-B")))).withColumn("next_item", F.when((F.col("n") == 1) | (F.col("item") <= half), F.col("item")).otherwise(F.col("item") - half))


def bisect_until_done(items: DataFrame, ask: Callable[[DataFrame], DataFrame], rounds: int = 60, keep: list[str] | None = None) -> DataFrame:
    """Rounds of bisection until nothing is open. items: (media_id, batch_id, item, ...) with `batch_id` told whole first.

    ask gets the open items with label ('<batch_id>', then '-A' and '-B' for each halving), item and n of the part, and
    gives (media_id, label, item, line) for the parts that it has answered; a part counts as answered if each of its
    items has a line. What is not answered is halved and asked again, a single item has failed for good. Result: the
    columns of items, or those of them in `keep`, with label, depth, line and failed, one row per item. A round asks for
    open items only; 2^k items need k + 1 rounds. Items are stored once, then each item once more when it is settled; what
    is open is one row per part, a range of items, laid among the items where they lie. Empty items give an empty result.
    """
    part = ["media_id", "label"]
    keep = items.columns if keep is None else keep
    own = [c for c in items.columns if c in {*keep, "media_id", "batch_id"} - {"item"}]
    base = chains.stored_as_dealt(items)
    place = items.schema["item"].dataType.simpleString()
    # the items over `low` up to `high`, null where open, of which the first is number low + 1
    parts = base.select("media_id", "batch_id").distinct().withColumn("__p", F.struct(F.col("batch_id").cast("string").alias("label"), F.lit(None).cast(place).alias("low"), F.lit(None).cast(place).alias("high")))
    done: DataFrame | None = None
    for depth in range(rounds):
        laid = base.withColumn("__at", F.col("item")).withColumn("__kind", F.lit(0)).unionByName(parts.withColumn("__at", F.col("__p.low")).withColumn("__kind", F.lit(1)), allowMissingColumns=True)
        so_far = W.partitionBy("media_id", "batch_id").orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, 0)
        left = laid.withColumn("__p", F.last("__p", ignorenulls=True).over(so_far)).where("__kind = 0 AND __p IS NOT NULL AND (__p.high IS NULL OR item <= __p.high)")
        left = left.withColumn("label", F.col("__p.label")).withColumn("__item", F.col("item")).withColumn("item", (F.col("item") - F.coalesce("__p.low", F.lit(0))).cast(place))
        left = left.withColumn("n", F.count("*").over(W.partitionBy(*part)))
        told = ask(left.drop("__item", "__at", "__kind", "__p")).select(*part, "item", "line").where("line IS NOT NULL").dropDuplicates([*part, "item"])
        tried = left.select(*own, "label", "item", "__item", "n", "__p").join(told, [*part, "item"], "left").withColumn("told", F.count("line").over(W.partitionBy(*part)))
        tried = tried.withColumn("failed", (F.col("told") < F.col("n")) & (F.col("n") == 1)).withColumn("open", (F.col("told") < F.col("n")) & (F.col("n") > 1))
        tried = tried.withColumn("__nth", F.row_number().over(W.partitionBy(*part).orderBy("item"))).where("NOT open OR __nth = 1")
        tried = chains.stored_as_dealt(tried.withColumn("line", F.when(~F.col("open") & ~F.col("failed"), F.col("line"))).drop("item", "told", "__nth"))
        settled = tried.where("NOT open").withColumn("item", F.col("__item")).withColumn("depth", F.lit(depth)).select(*keep, "label", "depth", "line", "failed")
        done = settled if done is None else done.unionByName(settled)
        open_ = tried.where("open")
        if open_.isEmpty():
            return done
        mid = (F.coalesce("__p.low", F.lit(0)) + F.expr("n div 2")).cast(place)
        half = lambda end, low, high: F.struct(F.concat("label", F.lit(end)).alias("label"), low.alias("low"), high.alias("high"))
        parts = open_.select("media_id", "batch_id", F.explode(F.array(half("-A", F.col("__p.low"), mid), half("-B", mid, F.col("__p.high")))).alias("__p"))
    raise RuntimeError("items are open after all rounds")


def glossary_hint(pairs: DataFrame, most: int = 20) -> DataFrame:
    """(glossary_id, hint): the first pairs, 'a -> b; c -> d', both sides trimmed and not blank."""
    r = pairs.where(~blank("term") & ~blank("translation")).withColumn("rn", F.row_number().over(W.partitionBy("glossary_id").orderBy("pos"))).where(F.col("rn") <= most)
    return r.groupBy("glossary_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", F.concat(F.trim("term"), F.lit(" -> "), F.trim("translation")).alias("t")))), lambda x: x["t"]), "; ").alias("hint"))


def block_translation_join(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Lines of a recording's answer block zipped by position with its items (media_id, item), where both have equally many."""
    n = F.count("*").over(W.partitionBy("media_id"))  # beside the rows, so that neither side is made twice
    a = answers.select("media_id", F.posexplode(F.split("answer", "\n")).alias("p", "line")).select("media_id", (F.col("p") + 1).alias("item"), "line", n.alias("__n"))
    return items.withColumn("__n", n).join(a, ["media_id", "item", "__n"]).drop("__n")


def context_entries(batches: DataFrame, srt: DataFrame, margin: int = 6000, grow: float = 1.8, most: int = 40_000) -> DataFrame:
    """(media_id, batch_id, entry_id): subtitles that overlap the batch's window widened by the smallest margin that finds
    any (6, 10.8, 19.44, 34.992 s), else all of the recording: expand_context of context_classes."""
    return expand_context(context_classes(batches, srt, margin, grow, most), srt)


def expand_context(classes: DataFrame, srt: DataFrame) -> DataFrame:
    """(media_id, batch_id, entry_id) of context_classes, the rows that stand for a whole recording written out."""
    whole = classes.where("whole").select("media_id", "batch_id").join(srt.select("media_id", "entry_id").hint("merge"), "media_id")
    return classes.where("NOT whole").select("media_id", "batch_id", "entry_id").unionByName(whole)


def context_classes(batches: DataFrame, srt: DataFrame, margin: int = 6000, grow: float = 1.8, most: int = 40_000) -> DataFrame:
    """(media_id, batch_id, entry_id, whole): the subtitles near each batch; a batch that has none near is one row with
    `whole` and no entry, which stands for all of its recording, so that the rows stay in proportion to the input."""
    rungs, m = [], float(margin)
    while m <= most:
        rungs.append(round(m))
        m *= grow
    from cuelane.operators.intervals import overlap_join

    wide = batches.withColumn("a", F.col("start_ms") - rungs[-1]).withColumn("b", F.col("end_ms") + rungs[-1]).withColumnsRenamed({"start_ms": "b0", "end_ms": "b1"})
    e = srt.select("media_id", "entry_id", "start_ms", "end_ms")
    shift = 10_000_000  # buckets are counted from below zero
    j = overlap_join(wide.withColumn("a", F.col("a") + shift).withColumn("b", F.col("b") + shift), e.withColumn("e0", F.col("start_ms") + shift).withColumn("e1", F.col("end_ms") + shift), "a", "b", "e0", "e1")
    need = F.greatest(F.col("b0") - F.col("end_ms"), F.col("start_ms") - F.col("b1"))  # overlap with margin m iff need < m
    rung = F.lit(rungs[-1])
    for r in reversed(rungs[:-1]):
        rung = F.when(need < r, r).otherwise(rung)
    near = j.withColumn("rung", rung).withColumn("low", F.min("rung").over(W.partitionBy("media_id", "batch_id"))).where("rung = low").select("media_id", "batch_id", "entry_id")
    rest = batches.join(near.select("media_id", "batch_id").distinct(), ["media_id", "batch_id"], "left_anti")
    return near.withColumn("whole", F.lit(False)).unionByName(rest.select("media_id", "batch_id", F.lit(None).cast(e.schema["entry_id"].dataType).alias("entry_id"), F.lit(True).alias("whole")))


def choose_alignment(lines: DataFrame) -> DataFrame:
    """Lines (media_id, batch_id, item, by_time, by_model, by_share, model_ok) with the text chosen per batch: the model's if
    valid, else by time if at least 0.4 of its lines are filled, else by share; below 0.6 blanks are filled by share."""
    w = W.partitionBy("media_id", "batch_id")
    c = lines.withColumn("coverage", F.avg(F.when(blank("by_time"), 0.0).otherwise(1.0)).over(w))
    base = F.when(F.col("model_ok"), F.col("by_model")).when(F.col("coverage") >= 0.4, F.col("by_time")).otherwise(F.col("by_share"))
    out = c.withColumn("text", base)
    return out.withColumn("text", F.when(blank("text") & (F.col("coverage") < 0.6), F.col("by_share")).otherwise(F.col("text")))


def parse_alignment_answer(answers: DataFrame) -> DataFrame:
    """(media_id, batch_id, item, text) of answers (n, answer) that hold a JSON list with each index 1..n once and no blank text; other answers are rejected whole. Keys: index or id, text or translation."""
    schema = "array<struct<index:int,id:int,text:string,translation:string>>"
    rows = answers.withColumn("list", F.from_json(F.regexp_extract("answer", "(?s)(\\[.*\\])", 1), schema))
    e = rows.select("media_id", "batch_id", "n", F.explode("list").alias("x")).select("media_id", "batch_id", "n", F.coalesce("x.index", "x.id").alias("item"), F.trim(F.coalesce("x.text", "x.translation", F.lit(""))).alias("text"))
    # checked beside the rows, so that answers are read once
    one = W.partitionBy("media_id", "batch_id", "n")
    told = {"c": F.count("*"), "u": F.collect_set("item"), "lo": F.min("item"), "hi": F.max("item"), "empty": F.count_if(F.col("text") == "")}
    e = e.where("media_id IS NOT NULL AND batch_id IS NOT NULL").select("*", *[f.over(one).alias(f"__{k}") for k, f in told.items()])
    ok = F.expr("__c = n AND size(__u) = n AND __lo = 1 AND __hi = n AND __empty = 0")
    return e.withColumn("__ok", F.max(ok).over(W.partitionBy("media_id", "batch_id"))).where("__ok").select("media_id", "batch_id", "item", "text")
