"""Reading level of texts from surprisals under interpolated n-gram models and isotonic regression."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.storage import materialize


@dataclass(frozen=True)
class ReadingRules:
    orders: int = 4  # longest character n-gram
    table_bits: int = 17  # hashed n-grams of one order and language, in a collection of up to ``bits_rows`` texts
    bits_rows: int = 1_000_000  # four times as many texts make the tables twice as large
    cells: int = 1 << 24  # of all tables: what is collected and broadcast is bounded by this
    models: int = 32  # labels with a model of their own, the most frequent ones; the rest share one
    shortlist: int = 3  # models that a text is read with, after a look at its letters, if there are many more
    backoff: float = 3.0  # weight of the shorter n-gram against the count of the longer one's context
    fit_bins: int = 40  # bins of a score in an isotonic fit
    fit_rounds: int = 4  # rounds in which rarity and length are fitted in turn
    fit_rows: int = 200_000  # labelled rows that are fitted; of more, a hashed sample of about as many
    demanding: float = 3.5  # fitted grade from which a text is of the highest level


SURE = 2_000_000  # characters of a label from which a single text doesn't matter to its model
BINS = 64  # of word surprisal, one bit each
_SENTENCE = re.compile(r"[.!?;…]+(?=\s|$)|\n+|\s/\s|(?:^|\s)[-•*–](?=\s)")
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str) -> list[list[str]]:
    """Words in lower case by sentence; list items and lines end a sentence as well."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFC", text) if unicodedata.category(c) != "Cf")
    return [w for w in (_WORD.findall(s) for s in _SENTENCE.split(text.lower())) if w]


def _codes(found: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, each with a blank before and the last with one after it per text; n words of each sentence and sentences of each text."""
    text = "".join(" " + " ".join(w for s in doc for w in s) for doc in found if doc) + " "
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([len(s) for d in found for s in d], np.int64), np.array([len(d) for d in found], np.int64)


def _hashed(codes: np.ndarray, orders: int, bits: int) -> list[np.ndarray]:
    """Bucket of the n-gram that ends at each place, by order; words' borders are part of it."""
    out, h = [], np.zeros(len(codes), np.uint64)
    for k in range(orders):
        shifted = np.concatenate([np.zeros(k, np.uint64), codes[: len(codes) - k].astype(np.uint64)]) if k else codes.astype(np.uint64)
        h = (h * np.uint64(1_000_003)) ^ (shifted + np.uint64(k + 1))
        out.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64))
    return out


def _count(rules: ReadingRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << rules.table_bits
        tables: dict[int, np.ndarray] = {}
        for b in batches:
            model = b.column("model").to_numpy(zero_copy_only=False)
            texts = b.column("text").to_pylist()
            for m in np.unique(model).tolist():
                codes, _, _ = _codes([sentences(texts[i]) for i in np.flatnonzero(model == m).tolist()])
                table = tables.setdefault(m, np.zeros((rules.orders, size), np.int32))
                for k, g in enumerate(_hashed(codes, rules.orders, rules.table_bits)):
                    table[k] += np.bincount(g, minlength=size)
        for m, table in tables.items():
            order, at = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), m, "i4")), pa.array(order.astype("i4")), pa.array(at.astype("i4")), pa.array(table[order, at].astype("i8"))], names=["model", "ord", "bucket", "n"])

    return run


def _contexts(grams: list[np.ndarray]) -> list[np.ndarray]:
    """Bucket of what comes before each place, by order; the first place has none (-1)."""
    return [np.r_[np.int64(-1), g[:-1]] for g in grams[:-1]]


def _bits(grams: list[np.ndarray], contexts: list[np.ndarray], table: np.ndarray, backoff: float, own: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    """Surprisal of each character under the interpolated model; ``own`` counts of each place's n-gram and context are left out."""
    total = max(1.0, float(table[0].sum()))
    seen = lambda k: table[k][grams[k]] - (own[k][0] if own else 0)
    p = 0.02 / 256 + 0.98 * np.maximum(seen(0), 0) / total
    for k in range(1, len(grams)):
        before = contexts[k - 1]
        context = np.where(before >= 0, table[k - 1][before], 0.0)
        if own:
            context = np.maximum(context - own[k][1], 0)
        p = (backoff * p + np.maximum(seen(k), 0)) / (context + backoff)
    return -np.log2(np.clip(p, 1e-12, 1.0))


def _own_counts(grams: list[np.ndarray], contexts: list[np.ndarray], text: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """How often each place's n-gram and context occur in the place's own text."""

    def times(bucket: np.ndarray, at: np.ndarray) -> np.ndarray:
        keys, n = np.unique(text << bits | bucket, return_counts=True)
        want = text << bits | np.maximum(at, 0)
        place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where((keys[place] == want) & (at >= 0), n[place], 0)

    return [(times(g, g), times(grams[k - 1], contexts[k - 1]) if k else np.zeros(len(g))) for k, g in enumerate(grams)]


def _read_apart(rules: ReadingRules, models_of):
    """Per label: surprisal of its texts under its own model without the text itself, and under the best model of a larger label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, sums = models_of.value, {}
        for b in batches:
            for m, text in zip(b.column("model").to_pylist(), b.column("text").to_pylist()):
                codes, _, per_text = _codes([sentences(text)])
                if not per_text.sum():
                    continue
                grams = _hashed(codes, rules.orders, rules.table_bits)
                contexts = _contexts(grams)
                own = _bits(grams, contexts, models[m], rules.backoff, _own_counts(grams, contexts, np.zeros(len(codes), np.int64), rules.table_bits)).sum()
                other = min(_bits(grams, contexts, x, rules.backoff).sum() for x in models[:m])
                held = sums.setdefault(m, [0.0, 0.0])
                held[0] += float(own)
                held[1] += float(other)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *(pa.array([x[i] for x in sums.values()], pa.float64()) for i in (0, 1))], names=["model", "own", "other"])

    return run


def _by_models(grams: list[np.ndarray], text: np.ndarray, n_texts: int, models: np.ndarray, rules: ReadingRules) -> tuple[np.ndarray, np.ndarray]:
    """The model of least surprisal of each text, and the surprisal of each place under it."""
    contexts = _contexts(grams)
    best, total, bits = np.zeros(n_texts, int), np.full(n_texts, np.inf), np.zeros(len(text))
    tried = np.ones((len(models), n_texts), bool)
    if len(models) > 2 * rules.shortlist:
        glance = np.stack([np.bincount(text, _bits(grams[:2], contexts[:1], m[:2], rules.backoff), n_texts) for m in models])
        tried = glance <= np.sort(glance, axis=0)[rules.shortlist - 1]
    for m, table in enumerate(models):
        every = tried[m].all()
        at = slice(None) if every else np.flatnonzero(tried[m][text])
        here = _bits([g[at] for g in grams], [c[at] for c in contexts], table, rules.backoff)
        cost = np.where(tried[m], np.bincount(text[at], here, n_texts), np.inf)
        better = cost < total
        best, total = np.where(better, m, best), np.where(better, cost, total)
        keep = better[text[at]]
        if every:
            bits = np.where(keep, here, bits)
        else:
            bits[at[keep]] = here[keep]
    return best, bits


def _measure(rules: ReadingRules, models_of):
    """Per text: best model, histogram of word surprisals, and the distribution of sentence surprisals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = models_of.value
        for b in batches:
            found = [sentences(t) for t in b.column("text").to_pylist()]
            codes, per_sentence, per_text = _codes(found)
            if not len(per_sentence):
                continue
            grams = _hashed(codes, rules.orders, rules.table_bits)
            blank = codes == 32
            n_words = int(blank.sum()) - 1
            word = np.minimum(np.cumsum(blank) - 1, n_words - 1)  # the word that a place belongs to, with its leading blank; the last blank goes to the last word
            words_of_text = np.array([sum(map(len, d)) for d in found], np.int64)
            text_of_word = np.repeat(np.arange(len(found)), words_of_text)
            sentence_of_word = np.repeat(np.arange(len(per_sentence)), per_sentence)
            text_of_sentence = np.repeat(np.arange(len(found)), per_text)
            grams, word = [g[:-1] for g in grams], word[:-1]
            best, places = _by_models(grams, text_of_word[word], len(found), models, rules)
            bits = np.bincount(word, places, n_words)
            total = np.bincount(text_of_word, bits, len(found))
            hist = np.bincount(text_of_word * BINS + np.minimum(bits, BINS - 1).astype(np.int64), minlength=len(found) * BINS).reshape(-1, BINS)
            per = np.bincount(sentence_of_word, bits, len(per_sentence))
            order = np.lexsort((per, text_of_sentence))
            per, start = per[order], np.cumsum(per_text) - per_text
            some = np.flatnonzero(per_text > 0)
            mid = (per[start[some] + (per_text[some] - 1) // 2] + per[start[some] + per_text[some] // 2]) / 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(some)), pa.array(best[some].astype("i4")), pa.array(words_of_text[some]), pa.array(total[some] / words_of_text[some]), pa.array(mid), pa.array([x.tobytes() for x in hist[some].astype(np.uint32)], pa.binary())], names=["doc_id", "model", "n_words", "word_bits", "sentence_bits", "hist"])

    return run


def _total_hist(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        hist = np.frombuffer(b"".join(b.column("hist").to_pylist()), np.uint32).reshape(-1, BINS)
        model = b.column("model").to_numpy(zero_copy_only=False)
        for m in np.unique(model).tolist():
            total[m] = total.get(m, 0) + hist[model == m].sum(0, dtype=np.int64)
    for m, h in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([m] * BINS, pa.int32()), pa.array(range(BINS), pa.int32()), pa.array(h)], names=["model", "bin", "n"])


def _scores(rank: np.ndarray, mean: np.ndarray):
    """Rarity: mean rank of the text's words among its language's; length: median sentence in the language's usual words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            hist = np.frombuffer(b"".join(b.column("hist").to_pylist()), np.uint32).reshape(n, BINS)
            model = b.column("model").to_numpy(zero_copy_only=False)
            rarity = (hist * rank[model]).sum(1) / np.maximum(hist.sum(1), 1)
            length = b.column("sentence_bits").to_numpy(zero_copy_only=False) / mean[model]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), b.column("word_bits"), b.column("sentence_bits"), pa.array(rarity), pa.array(length)], names=["doc_id", "n_words", "word_bits", "sentence_bits", "rarity", "length"])

    return run


def pool_adjacent(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Isotonic regression: the non-decreasing sequence nearest to ``value``."""
    blocks: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist()):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.empty(0)


def fit_isotonic(x: np.ndarray, y: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Score and fitted grade of bins of equally many rows, a score's ties being in one bin."""
    value, which = np.unique(x, return_inverse=True)
    weight = np.bincount(which, minlength=len(value))
    label = (np.cumsum(weight) - 1) * bins // max(1, len(x))
    n = np.bincount(label[which])
    some = n > 0
    mean = lambda v: np.bincount(label[which], v)[some] / n[some]
    return mean(x), pool_adjacent(mean(y), n[some].astype(float))


def fit_levels(rarity: np.ndarray, length: np.ndarray, grade: np.ndarray, rules: ReadingRules) -> list[tuple[np.ndarray, np.ndarray]]:
    """Maps of rarity, of length and of the smaller of the two.

    Each of the first two is fitted again on the rows that it limits, since in all rows the other one blurs it.
    """
    if not len(grade):
        nothing = (np.array([0.0]), np.array([np.nan]))
        return [nothing] * 3
    maps = [fit_isotonic(x, grade, rules.fit_bins) for x in (rarity, length)]
    for _ in range(rules.fit_rounds):
        a, b = np.interp(rarity, *maps[0]), np.interp(length, *maps[1])
        maps = [fit_isotonic(rarity[b >= a - 0.25], grade[b >= a - 0.25], rules.fit_bins), fit_isotonic(length[a >= b - 0.25], grade[a >= b - 0.25], rules.fit_bins)]
    both = np.minimum(np.interp(rarity, *maps[0]), np.interp(length, *maps[1]))
    return [*maps, fit_isotonic(both, grade, rules.fit_bins)]


def _graded(maps: list[tuple[np.ndarray, np.ndarray]]):
    """The smaller of the two grades that rarity and length alone would give, set against the grades once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = np.minimum(*(np.interp(b.column(c).to_numpy(zero_copy_only=False), *m) for c, m in zip(("rarity", "length"), maps)))
            both = np.interp(both, *maps[2])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(both)], names=[*b.schema.names, "level_score"])

    return run


def _sized(rules: ReadingRules, rows: int, models: int) -> ReadingRules:
    """Tables that grow with the square root of the collection, as the number of distinct n-grams does, within ``cells``."""
    bits = rules.table_bits + max(0, int(np.log2(max(1, rows) / rules.bits_rows) // 2))
    return replace(rules, table_bits=max(rules.table_bits, min(bits, int(np.log2(rules.cells / (models * rules.orders))))))


def _languages(texts: DataFrame, tables: np.ndarray, rules: ReadingRules) -> np.ndarray:
    """Which labels are languages: the largest, and each whose texts its own model reads better than those of larger labels.

    A text is left out of its label's model for that, since a small model knows its own texts by heart. In a large
    label one text counts for nothing, so its model is kept unasked: texts choose their model one by one later.
    """
    chars = tables[:, 0].sum(1)
    order = np.argsort(-chars, kind="stable")
    unsure = [int(m) for m in order[1:] if 0 < chars[m] < SURE]
    kept = [int(m) for m in order if chars[m] > 0 and m not in unsure] or [int(order[0])]
    if unsure:
        place = {int(m): i for i, m in enumerate(order)}
        ranked = F.coalesce(*[F.when(F.col("model") == m, place[m]) for m in unsure]).cast("int")
        models = texts.sparkSession.sparkContext.broadcast(tables[order])
        sums = texts.filter(F.col("model").isin(unsure)).select(ranked.alias("model"), "text").mapInArrow(_read_apart(rules, models), "model int, own double, other double").groupBy("model").agg(F.sum("own").alias("own"), F.sum("other").alias("other")).collect()
        kept += [int(order[r.model]) for r in sums if r.own < r.other]
    return np.array(sorted(kept))


def reading_levels(documents: DataFrame, labels: DataFrame, language: str | None = None, rules: ReadingRules = ReadingRules()) -> DataFrame:
    """(doc_id, n_words, word_bits, sentence_bits, rarity, length, level_score, level) of every text with a word.

    documents(doc_id bigint, text string[, language]); labels(doc_id, grade). A character n-gram model is trained
    on all texts of each language label (the most frequent ``models`` - 1, the others together), and kept if it reads
    its label's texts better than the models of larger labels do, however rare the label is; a text is read with the model that finds it least surprising,
    whatever its label says. Two scores come from the distribution of surprisal: how rare its words are among
    those of its language, and how much a sentence holds. Isotonic regression maps either to a grade, the smaller
    one counts, since neither alone makes a text demanding, and a last regression sets it against the grades. The
    fit takes at most about ``fit_rows`` labelled rows.
    NULL and wordless texts have no level; several grades of one text all count, NULL grades don't; without any
    grades level is NULL. Equal texts get equal levels.
    """
    spark = documents.sparkSession
    label = F.lower(F.substring(F.trim(F.col(f"`{language}`").cast("string")), 1, 2)) if language else F.lit("")
    texts = documents.filter("text is not null").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.coalesce(label, F.lit("?")).alias("lang"))
    sizes = {r.lang: r["count"] for r in texts.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rules.models - 1).collect()}
    top = list(sizes)
    number = F.lit(len(top))
    for i, name in enumerate(top):
        number = F.when(F.col("lang") == name, i).otherwise(number)
    texts = texts.withColumn("model", number.cast("int"))
    rules = _sized(rules, sum(sizes.values()), len(top) + 1)
    counts = texts.select("model", "text").mapInArrow(_count(rules), "model int, ord int, bucket int, n bigint").groupBy("model", "ord", "bucket").agg(F.sum("n").alias("n")).toArrow()  # rules.cells rows at most
    tables = np.zeros((len(top) + 1, rules.orders, 1 << rules.table_bits), np.float32)
    tables[tuple(counts[c].to_numpy() for c in ("model", "ord", "bucket"))] = counts["n"].to_numpy()
    del counts
    tables = tables[_languages(texts, tables, rules)]
    measured = materialize(texts.select("doc_id", "text").mapInArrow(_measure(rules, spark.sparkContext.broadcast(tables)), "doc_id bigint, model int, n_words bigint, word_bits double, sentence_bits double, hist binary"), "surprisal")
    hist = np.zeros((len(tables), BINS))
    for r in measured.select("model", "hist").mapInArrow(_total_hist, "model int, bin int, n bigint").groupBy("model", "bin").agg(F.sum("n").alias("n")).collect():
        hist[r.model, r.bin] = r.n
    n = np.maximum(hist.sum(1, keepdims=True), 1)
    rank = (np.cumsum(hist, 1) - hist / 2) / n
    mean = np.maximum((hist * (np.arange(BINS) + 0.5)).sum(1) / n[:, 0], 1e-9)
    columns = "doc_id bigint, n_words bigint, word_bits double, sentence_bits double, rarity double, length double"
    scored = measured.mapInArrow(_scores(rank, mean), columns)
    graded = labels.filter("grade is not null").select(F.col("doc_id").cast("bigint"), F.col("grade").cast("double"))
    sample = materialize(scored.join(graded, "doc_id").select("doc_id", "rarity", "length", "grade"), "graded")
    n_graded = sample.count()
    if n_graded > rules.fit_rows:
        sample = sample.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n_graded)) < rules.fit_rows)
    fitted = sample.toArrow()
    maps = fit_levels(*(fitted[c].to_numpy() for c in ("rarity", "length", "grade")), rules)
    out = scored.mapInArrow(_graded(maps), columns + ", level_score double")
    score = F.when(~F.isnan("level_score"), F.col("level_score"))
    whole = F.least(F.lit(3), F.greatest(F.lit(1), F.round("level_score")))
    level = F.when(F.col("level_score") >= rules.demanding, 4).when(F.col("level_score").isNotNull(), whole)
    return out.withColumn("level_score", score).withColumn("level", level.cast("int"))
