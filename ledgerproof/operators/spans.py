"""Token offsets, span-token alignment and span tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import accumulate
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerproof.functions.numbers import exact_mean, exact_mean_of_units
from ledgerproof.operators.ordering import running_offsets, running_totals
from ledgerproof.session import durable

# The markers token texts may carry.
REPLACEMENT = "�"
APPROX = "≈"
SPECIAL_PREFIX, SPECIAL_SUFFIX = "<|", "|>"


def is_special(token_text: Column) -> Column:
    return token_text.startswith(SPECIAL_PREFIX) & token_text.endswith(SPECIAL_SUFFIX)


def placed_tokens(tokens: DataFrame, key: Sequence[str] = ("qid",), chunk: int = 4096) -> DataFrame:
    """Repaired text and half-open character offsets of every token, in one scan.

    A token ending in U+FFFD followed by a lone U+FFFD becomes its prefix plus an approximation
    sign. Pairs form left to right inside a run of such tokens, so the place in the run decides;
    neighbours meet by position. Special tokens have no width.

    A document is cut into chunks of positions. What a chunk leaves open is one row: its width
    for either way in which a run can enter it, how it begins, and the run at its end. The rows of
    a document are put together in order, and each chunk gets the state that it starts with.
    Adds display_text, is_special_token, aligned_text, char_start and char_end.
    """
    keys = [*key, "_chunk"]
    inside = Window.partitionBy(*keys).orderBy("position")
    upto, before = (inside.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    text, at = F.col("token_text"), F.col("position")
    lone, marked = text == REPLACEMENT, text.endswith(REPLACEMENT)
    joins = lone & (F.lag(at).over(inside) == at - 1) & F.lag(marked).over(inside)
    local = tokens.withColumn("_chunk", F.floor(at / chunk)).withColumns(
        {
            "_head": F.first(F.struct(at.alias("at"), lone.alias("lone"))).over(upto),
            "_start": F.when(marked & ~F.coalesce(joins, F.lit(False)), at),
            "_followed": F.coalesce((F.lead(at).over(inside) == at + 1) & F.lead(lone).over(inside), F.lit(False)),
        }
    )
    local = local.withColumn("_start", F.last("_start", ignorenulls=True).over(upto))
    # A run that may have begun in an earlier chunk.
    entered = marked & F.col("_head.lone") & (F.col("_start") == F.col("_head.at"))

    def odd(entering: Column) -> Column:
        return F.pmod(at - F.col("_start") + F.when(entered, entering).otherwise(0), F.lit(2)) == 1

    def width(entering: int) -> Column:
        cut = marked & F.col("_followed") & ~odd(F.lit(entering))
        return F.sum(F.when(is_special(text), 0).otherwise(F.length(text) - F.coalesce(cut, F.lit(False)).cast("int")))

    rows = local.groupBy(*keys).agg(
        F.min(F.struct(at.alias("at"), lone.alias("lone"))).alias("_from"),
        F.max(F.struct(at.alias("at"), marked.alias("marked"), F.col("_start").alias("start"), entered.alias("entered"))).alias("_to"),
        width(0).alias("_even"), width(1).alias("_odd"),
    )
    along = Window.partitionBy(*key).orderBy("_chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    last, following = F.lag("_to").over(along), F.lead("_from").over(along)
    states = rows.withColumns(
        {
            "_continues": F.coalesce(F.col("_from.lone") & (last["at"] == F.col("_from.at") - 1) & last["marked"], F.lit(False)),
            "_next": F.coalesce(following["lone"] & (following["at"] == F.col("_to.at") + 1), F.lit(False)),
        }
    )
    open_start = F.when(~(F.col("_to.entered") & F.col("_continues")), F.col("_to.start"))
    states = states.withColumn("_open", F.last(open_start, ignorenulls=True).over(earlier))
    states = states.withColumn("_entering", F.when(F.col("_continues"), F.pmod(F.col("_from.at") - F.col("_open"), F.lit(2))).otherwise(0))
    place = F.col("_to.at") - F.col("_to.start") + F.when(F.col("_to.entered"), F.col("_entering")).otherwise(0)
    cut_at_end = F.col("_next") & F.col("_to.marked") & (F.pmod(place, F.lit(2)) == 0)
    total = F.when(F.col("_entering") == 1, F.col("_odd")).otherwise(F.col("_even")) - F.coalesce(cut_at_end, F.lit(False)).cast("int")
    states = states.select(
        *keys, "_entering", "_next", F.col("_to.at").alias("_end"), F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias("_ahead")
    )
    special = is_special(text)
    cut = (F.col("_followed") | (F.col("_next") & (at == F.col("_end")))) & ~odd(F.col("_entering"))
    shown = F.when(marked & odd(F.col("_entering")), APPROX).when(marked & cut, F.expr("substring(token_text, 1, length(token_text) - 1)")).otherwise(text)
    return (
        local.join(states, keys)
        .withColumn("display_text", shown)
        .withColumns({"is_special_token": special, "aligned_text": F.when(special, "").otherwise(F.col("display_text"))})
        .withColumn("char_start", F.col("_ahead") + F.coalesce(F.sum(F.length("aligned_text")).over(before), F.lit(0)))
        .withColumn("char_end", F.col("char_start") + F.length("aligned_text"))
        .select(*tokens.columns, "display_text", "is_special_token", "aligned_text", "char_start", "char_end")
    )


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, however often its lambdas use it. A transform would copy what
    `then` gives, with all texts in it; the end of an aggregate over one row doesn't."""
    return F.aggregate(F.array(F.lit(0)), value, lambda held, _: held, then)


def repaired(pieces: Column) -> Column:
    """The display texts of a document's token texts, by the rule of `placed_tokens`.

    Each token is one letter, and pairs are found left to right in the word of letters.
    """
    marks = F.transform(pieces, lambda t: F.when(t == REPLACEMENT, "L").when(t.endswith(REPLACEMENT), "M").otherwise("-"))
    paired = F.split(F.regexp_replace(F.array_join(marks, ""), "[LM]L", "PA"), "")
    shown = F.zip_with(
        pieces, paired,
        lambda t, m: F.when(m == "A", APPROX).when(m == "P", F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t),
    )
    return F.when(F.contains(F.array_join(pieces, ""), F.lit(REPLACEMENT)), shown).otherwise(pieces)


def blocks(
    documents: DataFrame, items: Column, parts: Mapping[str, Callable[[Column], Column]], width: Callable[..., Column],
    total: Callable[..., Column], made: Mapping[str, Callable[..., Column]] | None = None, size: int = 16,
) -> DataFrame:
    """The items of a document, an array, in rows of `size` items with their offsets.

    `parts` are arrays made of the items, of one length. `width` is worked out of an item's parts,
    `total` (the sum of widths) of the parts of a block, `made` of an item's parts again. Adds first
    (the place of the first item), start and until (where the block starts and ends), edges (where each item
    of it starts, and where the last one ends), the block's piece of each part, and what is made.
    Nothing is shuffled. Inside the document only blocks' totals are summed, in sums of sums; items are
    summed behind that as columns of their block's row, which compiles, and lambdas don't.
    """

    def running(start: Column, values: Column) -> Column:
        return F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def sliced(values: Column, step: int) -> Column:
        count = F.size(values)
        return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1, F.lit(step))), lambda i: F.slice(values, i + 1, step))

    def starts(groups: Column) -> Column:
        sums = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda sum_, x: sum_ + x))
        return _bound(running(F.lit(0), sums), lambda ahead: F.flatten(
            F.transform(groups, lambda g, k: F.slice(running(F.get(ahead, k), g), F.lit(1), F.size(g)))))

    def cut(all_: Column) -> Column:
        count = F.size(all_[names[0]])
        firsts = F.when(count > 0, F.sequence(F.lit(0), count - 1, F.lit(size)))

        def part(i: Column) -> Column:
            return F.struct(*[F.slice(all_[c], i + 1, size).alias(c) for c in names])

        def placed(totals: Column) -> Column:
            # Slices once more, since each array that is made of texts copies them.
            return _bound(_bound(sliced(totals, 64), starts), lambda at: F.transform(firsts, lambda i, k: F.struct(
                i.alias("first"), F.get(at, k).alias("start"), (F.get(at, k) + F.get(totals, k)).alias("until"), part(i).alias("part"))))

        return _bound(F.transform(firsts, lambda i: _bound(part(i), lambda held: total(*[held[c] for c in names]))), placed)

    names = list(parts)
    # As an array of objects, of which a slice costs its own length only; a transform would copy each text.
    held = _bound(F.slice(items, F.lit(1), F.size(items)), lambda all_: F.struct(*[make(all_).alias(c) for c, make in parts.items()]))
    # explode would infer a filter on its array, which would be made once more for it.
    rows = documents.select(*documents.columns, F.explode_outer(_bound(held, cut)).alias("_block")).filter("_block IS NOT NULL")
    rows = rows.select(*documents.columns, F.col("_block.first").cast("bigint").alias("first"), "_block.start", "_block.until", *[F.col(f"_block.part.{c}").alias(c) for c in names])

    def each(of: Callable[..., Column]) -> list[Column]:
        return [of(*[F.get(c, F.lit(i)) for c in names]) for i in range(size)]

    def sums(start: Column, values: Sequence[Column]) -> list[Column]:
        return list(accumulate([start, *values], add))

    # In eights: a sum of many columns holds the sums before it, and its code grows with their number.
    count, eights = F.size(names[0]), range(0, size, 8)
    summed = rows.withColumns({f"_w{i}": F.coalesce(w, F.lit(0)) for i, w in enumerate(each(width))})
    summed = summed.withColumns({f"_sums{k}": F.array(*sums(F.lit(0), [F.col(f"_w{i}") for i in range(k, min(k + 8, size))])) for k in eights})
    summed = summed.withColumn("_ahead", F.array(*sums(F.col("start"), [F.element_at(f"_sums{k}", -1) for k in eights])))
    ends = [F.get("_ahead", F.lit(i // 8)) + F.get(f"_sums{i - i % 8}", F.lit(i % 8 + 1)) for i in range(size)]
    finished = {"edges": F.slice(F.array("start", *ends), F.lit(1), count + 1)}
    finished |= {c: F.slice(F.array(*each(of)), F.lit(1), count) for c, of in (made or {}).items()}
    # Comes out of a generator, so that no filter above takes these long expressions down with it.
    told = F.explode_outer(F.array(F.struct(*[c.alias(name) for name, c in finished.items()]))).alias("_told")
    told = summed.select(*documents.columns, "first", "start", "until", *names, told)
    return told.select(*documents.columns, "first", "start", "until", *names, *[f"_told.{c}" for c in finished])


def placed_items(blocked: DataFrame, carry: Sequence[str], fields: Sequence[str], start: str, end: str, position: str = "position") -> DataFrame:
    """One row per item of `blocks`: its place, its fields and its half-open offsets."""
    at = F.col("_at")
    rows = blocked.select(*carry, "first", "edges", *fields, F.explode_outer(F.sequence(F.lit(0), F.size("edges") - 2)).alias("_at"))
    return rows.select(
        *carry, (F.col("first") + at).alias(position), *[F.get(f, at).alias(f) for f in fields],
        F.get("edges", at).cast("bigint").alias(start), F.get("edges", at + 1).cast("bigint").alias(end),
    )


def token_blocks(
    documents: DataFrame, fields: Mapping[str, Column] | None = None, pieces: str = "pieces", size: int = 16, lengths: str | None = None
) -> DataFrame:
    """What `placed_tokens` finds, of documents that hold their token texts as an array.

    Special tokens have no width. Without other fields a block has token_text and display_text;
    `lengths` names a column with the lengths of the token texts instead, NULL where all are as long as they are wide.
    """
    parts = {"token_text": lambda texts: texts, "display_text": repaired}
    parts |= {c: (lambda _, values=values: F.transform(values, lambda x: x)) for c, values in (fields or {}).items()}

    def width(text: Column, shown: Column, *_) -> Column:
        return F.when(is_special(text), 0).otherwise(F.length(shown))

    def total(texts: Column, shown: Column, *_) -> Column:
        hidden = F.aggregate(texts, F.lit(0), lambda sum_, t: sum_ + F.when(is_special(t), F.length(t)).otherwise(0))
        return F.length(F.array_join(shown, "")) - F.when(F.contains(F.array_join(texts, ""), F.lit(SPECIAL_PREFIX)), hidden).otherwise(0)

    made = {lengths: lambda text, *_: F.length(text)} if lengths else {}
    cut = blocks(documents, F.col(pieces), parts, width, total, made, size).drop(pieces)
    if lengths:
        # No token is wider than it is long, so where the sums are equal all of them are.
        cut = cut.withColumn(lengths, F.when(F.length(F.array_join("token_text", "")) != F.col("until") - F.col("start"), F.col(lengths)))
    return cut.drop("token_text", "display_text") if fields or lengths else cut


def unpacked_tokens(blocked: DataFrame, carry: Sequence[str] = ("qid", "lang")) -> DataFrame:
    """One row per token of `token_blocks`."""
    special = is_special(F.col("token_text"))
    return placed_items(blocked, carry, ["token_text", "display_text"], "char_start", "char_end").withColumns(
        {"is_special_token": special, "aligned_text": F.when(special, "").otherwise(F.col("display_text"))})


def repair_byte_pairs(tokens: DataFrame, key: Sequence[str] = ("qid",)) -> DataFrame:
    """Adds `display_text` only; see `placed_tokens`."""
    return placed_tokens(tokens, key).select(*tokens.columns, "display_text")


def token_offsets(tokens: DataFrame, key: Sequence[str] = ("qid",)) -> DataFrame:
    """Half-open character offsets from the widths of display_text; special tokens have width 0."""
    special = is_special(F.col("token_text"))
    sized = tokens.withColumns(
        {
            "is_special_token": special,
            "aligned_text": F.when(special, "").otherwise(F.col("display_text")),
            "_width": F.when(special, 0).otherwise(F.length("display_text")),
        }
    )
    return (
        running_offsets(sized, key, "position", "_width", "char_start")
        .withColumn("char_end", F.col("char_start") + F.col("_width"))
        .drop("_width")
    )


def overlap_join(spans: DataFrame, tokens: DataFrame, key: str = "qid", width: int = 256) -> DataFrame:
    """Spans with every token they overlap; both half-open and strict.

    The equi-key is the document and a character bucket, so a long document spreads
    over many tasks. A pair is kept only in the bucket where the later of the two
    starts lies, so no pair comes out twice and nothing has to be deduplicated.
    """
    def buckets(start: Column, end: Column) -> Column:
        low = F.floor(start / width)
        return F.explode(F.sequence(low, F.greatest(low, F.floor((end - 1) / width))))

    real = tokens.filter(~F.col("is_special_token") & (F.col("char_end") > F.col("char_start")))
    left = spans.withColumn("_bucket", buckets(F.col("span_start_char"), F.col("span_end_char")))
    right = real.withColumn("_bucket", buckets(F.col("char_start"), F.col("char_end")))
    later = F.floor(F.greatest("span_start_char", "char_start") / width)
    return (
        left.join(right, [key, "_bucket"])
        .filter((F.col("char_end") > F.col("span_start_char")) & (F.col("char_start") < F.col("span_end_char")))
        .filter(F.col("_bucket") == later)
        .drop("_bucket")
    )


def block_overlap_join(
    spans: DataFrame, blocked: DataFrame, carry: Sequence[str] = (), fields: Sequence[str] = (), key: str = "qid", width: int = 1024
) -> DataFrame:
    """`overlap_join` with `token_blocks`: spans with every token of some width that they overlap.

    A block crosses the shuffle with its edges and fields, not with its texts. A span meets a block in the bucket
    where the later of the two starts lies, so once, and then the block's tokens.
    Adds carry, position, the fields, char_start and char_end.
    """
    def buckets(start: Column, end: Column) -> Column:
        low = F.floor(start / width)
        return F.explode_outer(F.sequence(low, F.greatest(low, F.floor((end - 1) / width))))

    low, high, at = F.col("span_start_char"), F.col("span_end_char"), F.col("_at")
    left = spans.withColumn("_bucket", buckets(low, high))
    # A block's edges cross the shuffle as distances from its start, in two bytes each unless it is very wide.
    wide = F.col("until") - F.col("start") >= 2**15
    near = F.when(~wide, F.transform("edges", lambda edge: (edge - F.col("start")).cast("smallint")))
    far = F.when(wide, F.transform("edges", lambda edge: edge - F.col("start")))
    right = blocked.select(
        key, *carry, "first", F.col("start").alias("_begin"), near.alias("_near"), far.alias("_far"), *fields, buckets(F.col("start"), F.col("until")).alias("_bucket"))
    begin, last = F.col("_begin"), F.coalesce(F.size("_near"), F.size("_far")) - 1

    def edge(i: Column) -> Column:
        return begin + F.coalesce(F.get("_near", i).cast("int"), F.get("_far", i))

    met = (
        left.join(right, [key, "_bucket"])
        .filter((edge(last) > low) & (begin < high) & (F.col("_bucket") == F.floor(F.greatest(low, begin) / width)))
    )
    start, end = edge(at), edge(at + 1)
    rows = met.withColumn("_at", F.explode_outer(F.sequence(F.lit(0), last - 1)))
    return rows.filter((end > low) & (start < high) & (end > start)).select(
        *spans.columns, *[c for c in carry if c not in spans.columns], (F.col("first") + at).alias("position"),
        *[F.get(f, at).alias(f) for f in fields], start.cast("bigint").alias("char_start"), end.cast("bigint").alias("char_end"),
    )


SIMPLE_MEANS = {"mean_token_logprob": "token_logprob", "mean_token_entropy": "token_entropy", "mean_top2_margin": "top2_margin"}
ENERGY_MEANS = {
    "mean_selected_step_energy_gap": "selected_step_energy_gap",
    "mean_spilled_energy_delta": "spilled_energy_delta",
    "mean_spilled_energy_abs_delta": "spilled_energy_abs_delta",
    "mean_token_energy": "token_energy",
    "mean_marginal_energy": "marginal_energy",
    "mean_spilled_probability_mass_after_top1": "spilled_probability_mass_after_top1",
    "mean_spilled_probability_mass_after_top2": "spilled_probability_mass_after_top2",
}
ENERGY_MAXIMA = {
    "max_selected_step_energy_gap": "selected_step_energy_gap",
    "max_spilled_energy_abs_delta": "spilled_energy_abs_delta",
}
FEATURES = (
    *SIMPLE_MEANS, "mean_token_nll", "max_token_entropy", "min_top2_margin", *ENERGY_MEANS, *ENERGY_MAXIMA
)


def _all_or_none(aggregate: Column, c: str) -> Column:
    return F.when(F.count_if(F.col(c).isNull()) == 0, aggregate)


def feature_aggregates(units: Mapping[str, int] | None = None) -> list[Column]:
    """The fifteen span features. Energy features exist only where every token has them.

    Scores are decimals or doubles, or, if `units` gives a scale for each, whole numbers that count units of
    10**-scale: many rows are summed much faster so.
    """

    def mean(c: str) -> Column:
        return exact_mean_of_units(F.col(c), units[c]) if units else exact_mean(F.col(c))

    def end(of: Callable[[str], Column], c: str) -> Column:
        value = of(c).cast("double")
        if units:
            value = value / 10.0 ** units[c]
        return value if units and units[c] <= 6 else F.round(value, 6)

    out = [mean(c).alias(n) for n, c in SIMPLE_MEANS.items()]
    out += [
        (-mean("token_logprob")).alias("mean_token_nll"),
        end(F.max, "token_entropy").alias("max_token_entropy"),
        end(F.min, "top2_margin").alias("min_top2_margin"),
    ]
    out += [_all_or_none(mean(c), "selected_step_energy_gap").alias(n) for n, c in ENERGY_MEANS.items()]
    out += [_all_or_none(end(F.max, c), "selected_step_energy_gap").alias(n) for n, c in ENERGY_MAXIMA.items()]
    return out


def span_features(pairs: DataFrame, carry: Sequence[str] = (), units: Mapping[str, int] | None = None) -> DataFrame:
    """One row per span: token window and features; `units` as in `feature_aggregates`."""
    return pairs.groupBy("annotation_id").agg(
        *[F.first(c).alias(c) for c in carry],
        F.count("*").alias("token_count"),
        F.min("position").alias("token_start_position"),
        (F.max("position") + 1).alias("token_end_position"),
        F.min("char_start").alias("token_char_start"),
        F.max("char_end").alias("token_char_end"),
        *feature_aggregates(units),
    )


def align(
    annotations: DataFrame, generations: DataFrame, tokens: DataFrame,
    overlap: Callable[[DataFrame, DataFrame], DataFrame] = overlap_join, units: Mapping[str, int] | None = None,
) -> DataFrame:
    """Annotation, generation and token trace by document. A missing or unfit partner
    yields a failure reason, not an error; good rows carry features and boundary slop.
    `overlap` joins spans with the tokens in the form given; `units` is that of `span_features`."""
    slice_ = F.expr("substring(generated_text, span_start_char + 1, span_end_char - span_start_char)")
    joined = annotations.join(generations.select("qid", "generated_text"), "qid", "left")
    checked = joined.select(
        *annotations.columns,
        F.when(F.col("generated_text").isNull(), "missing generation")
        .when(slice_ != F.col("span_text"), "span text is not at its offsets")
        .alias("reason"),
    )
    fit = checked.filter("reason IS NULL")
    features = span_features(overlap(fit, tokens), units=units)
    return (
        checked.join(features, "annotation_id", "left")
        .withColumn(
            "reason", F.coalesce("reason", F.when(F.col("token_count").isNull(), "no overlapping tokens"))
        )
        .withColumn("left_boundary_slop", F.col("span_start_char") - F.col("token_char_start"))
        .withColumn("right_boundary_slop", F.col("token_char_end") - F.col("span_end_char"))
    )


def alignment_summary(aligned: DataFrame) -> DataFrame:
    good = aligned.filter("reason IS NULL")
    return good.agg(
        F.count("*").alias("aligned_span_count"),
        F.countDistinct("qid").alias("question_count"),
        F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"),
        F.round(F.sum("token_count").cast("double") / F.count("*"), 4).alias("mean_tokens"),
        F.max("left_boundary_slop").alias("max_left"),
        F.max("right_boundary_slop").alias("max_right"),
        F.count_if(F.col("left_boundary_slop") > 0).alias("spans_with_left_slop"),
        F.count_if(F.col("right_boundary_slop") > 0).alias("spans_with_right_slop"),
    )


def rebuilt(tokens: DataFrame, generations: DataFrame, chunk: int = 4096) -> DataFrame:
    """(qid, text_matches, length_matches): do the tokens rebuild the document?

    Texts are joined per chunk first, then per document; the result is as long as the
    stored text it is compared with.
    """
    pieces = tokens.groupBy("qid", F.floor(F.col("position") / chunk).alias("part")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "aligned_text"))), lambda x: x["aligned_text"]), ""
        ).alias("piece"),
        F.max("char_end").alias("char_end"),
    )
    return _rebuilt_of(pieces, generations)


def rebuilt_from_blocks(blocked: DataFrame, generations: DataFrame) -> DataFrame:
    """`rebuilt` of `token_blocks`: a block's texts are joined where it lies."""
    aligned = F.zip_with("token_text", "display_text", lambda t, shown: F.when(is_special(t), "").otherwise(shown))
    pieces = blocked.select("qid", F.col("first").alias("part"), F.array_join(aligned, "").alias("piece"), F.col("until").alias("char_end"))
    return _rebuilt_of(pieces, generations)


def _rebuilt_of(pieces: DataFrame, generations: DataFrame) -> DataFrame:
    texts = pieces.groupBy("qid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece"))), lambda x: x["piece"]), "").alias("rebuilt"),
        F.max("char_end").alias("char_end"),
    )
    return generations.join(texts, "qid", "left").select(
        "qid",
        F.coalesce(F.col("rebuilt") == F.col("generated_text"), F.lit(False)).alias("text_matches"),
        F.coalesce(F.col("char_end") == F.length("generated_text"), F.lit(False)).alias("length_matches"),
    )


def contiguous(positions: Column) -> Column:
    """Do the positions of a document leave no gap? Repeated ones count once."""
    return F.array_max(positions) - F.array_min(positions) + 1 == F.size(F.array_distinct(positions))


def greedy_tiling(spans: DataFrame, key: str = "qid") -> DataFrame:
    """Non-overlapping spans per document, first fit in (start, end) order.

    A span that starts at or after every earlier end is kept whatever came before it. After
    a kept span the next one kept is the first that starts at or after its end. These
    successors come from one ordered pass over starts and ends, and the chains from the spans
    that are kept for sure are followed in doubled jumps, so a chain of n spans takes log n
    joins and no document or run of overlapping spans is gathered anywhere.
    """
    order = [F.col("span_start_char"), F.col("span_end_char"), F.col("annotation_id")]
    placed = durable(running_totals(spans, order, [key], position="_p", earlier_max={"_end": F.col("span_end_char")}))
    heads = placed.filter(F.col("_end").isNull() | (F.col("span_start_char") >= F.col("_end")))
    events = placed.select(key, F.col("span_start_char").alias("_at"), F.lit(1).alias("_kind"), "_p").unionByName(
        placed.select(key, F.col("span_end_char").alias("_at"), F.lit(0).alias("_kind"), "_p"))
    # From the end backwards: at a span's end the least position whose start was seen is its successor.
    seen = running_totals(
        events, [F.desc("_at"), F.desc("_kind"), F.desc("_p")], [key], position="_place",
        earlier_max={"_least": F.when(F.col("_kind") == 1, -F.col("_p"))})
    jumps = durable(seen.filter("_kind = 0 AND _least IS NOT NULL").select(
        key, "_p", F.greatest(-F.col("_least"), F.col("_p") + 1).alias("_next")))
    kept = durable(heads.select(key, "_p"))
    while True:
        reached = kept.join(jumps, [key, "_p"]).select(key, F.col("_next").alias("_p")).distinct()
        new = durable(reached.join(kept, [key, "_p"], "left_anti"))
        if new.isEmpty():
            break
        kept = kept.unionByName(new)
        further = jumps.select(key, F.col("_p").alias("_next"), F.col("_next").alias("_far"))
        jumps = durable(jumps.join(further, [key, "_next"]).select(key, "_p", F.col("_far").alias("_next")))
    return placed.join(kept, [key, "_p"], "left_semi").select(key, "span_start_char", "span_end_char", "annotation_id")
