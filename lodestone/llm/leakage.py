"""Test items that leaked into a corpus, by latent semantic retrieval.

Every document is cut into overlapping passages; TF-IDF vectors of hashed words
are projected on the leading right singular vectors (randomised SVD, its products
summed by Spark), and passages whose latent cosine with a passage of a test item
is high make the item a candidate for the document.  The item passages are indexed
by random hyperplanes of the latent space, so a passage of the corpus is compared
with those of equal keys only.  Candidates are decided by the words both have in
common, in order, around the place where the passages meet: as one stretch with a
bounded share of errors, or, for paraphrases, as a longest common subsequence
together with the answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Hashed vocabulary; kept directions; passage lengths (words).  Passages of a document
#: begin half a length apart, those of an item an eighth.
HASHED, KEPT, PASSAGES = 1 << 14, 64, (16, 32)
_TAG = r"</?[A-Za-z][^<>]{0,40}>"


def words_of(text: str) -> list[str]:
    """Words of a text: what is between white space, in letters and digits only,
    lower case; tags are taken out (``br`` and ``p`` count as white space)."""
    return [w for w in map(_clean, _untagged(text).split()) if w]


def _untagged(text: str) -> str:
    import re

    if "<" not in text:
        return text
    return re.sub(_TAG, "", re.sub(r"<(?:br|p|/p)\b[^<>]{0,20}>", " ", text))


def _clean(token: str) -> str:
    return "".join(c for c in token.lower() if c.isalnum())


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Word hashes (32 bits) of every text, as bytes."""
    import xxhash

    known: dict[str, int] = {}

    def code(token: str) -> int:
        w = _clean(token)
        v = known[token] = max(1, xxhash.xxh32_intdigest(w)) if w else 0
        return v

    for batch in batches:
        out = []
        for text in batch["text"]:
            if len(known) > 500_000:
                known.clear()
            ids = [known[t] if t in known else code(t) for t in _untagged(text).split()]
            x = np.array(ids, dtype=np.uint32)
            out.append(x[x > 0].tobytes())
        yield pd.DataFrame({"id": batch["id"], "w": out})


def encode(rows: DataFrame) -> DataFrame:
    """id and w (four bytes a word) of the rows (id long, text) with words."""
    return rows.where(F.col("id").isNotNull() & F.col("text").isNotNull()).mapInPandas(_encode, "id long, w binary").where(F.length("w") > 0)


def _features(w: bytes) -> np.ndarray:
    return (np.frombuffer(w, dtype=np.uint32) & np.uint32(HASHED - 1)).astype(np.int64)


def idf(encoded: DataFrame) -> tuple[np.ndarray, int]:
    """Inverse document frequencies of the hashed words over all documents, and
    the number of documents.

    Tasks send one count per feature, so what reaches the driver is at most
    ``HASHED`` rows whatever the number of documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df = 0, np.zeros(HASHED, np.int64)
        for batch in batches:
            for w in batch["w"]:
                df[np.unique(_features(w))] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"f": np.r_[at, -1], "n": np.r_[df[at], n]})

    got = encoded.select("w").mapInPandas(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(HASHED)
    seen = got[got["f"] >= 0]
    df[seen["f"].to_numpy()] = seen["n"].to_numpy()
    n = int(got.loc[got["f"] < 0, "n"].sum())
    return np.log(1 + n / np.maximum(df, 1)).astype(np.float32), n


def _windows(x: np.ndarray, size: int, stride: int) -> np.ndarray:
    """Starts of the passages of a text with ``len(x)`` words; the last one ends with it."""
    last = max(len(x) - size, 0)
    at = np.arange(0, last + 1, stride)
    return at if at[-1] == last else np.append(at, last)


def _running(rows: np.ndarray) -> np.ndarray:
    c = np.empty((len(rows) + 1, rows.shape[1]), np.float32)
    c[0] = 0
    np.cumsum(rows, axis=0, out=c[1:])
    return c


def _sums(rows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of every passage."""
    c = _running(rows)
    return c[np.minimum(at + size, len(rows))] - c[at]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """out[at] += rows, repeated positions summed."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    out[at[starts]] += np.add.reduceat(rows[order], starts, axis=0)


def latent_basis(encoded: DataFrame, weights: np.ndarray, n: int, sample: int = 4_000, passes: int = 2, tasks: int = 12, seed: int = 5) -> np.ndarray:
    """Term matrix (``HASHED`` x ``KEPT``) of the randomised SVD of the passages.

    Fitted on about ``sample`` of the ``n`` documents, those whose id hashes below
    a bound (a bounded sample; the index and the search cover all).  Each pass multiplies the
    passage matrix and its transpose with the current basis inside the tasks and
    adds the products up per block of features; the basis is made orthonormal in
    between.
    """
    spark = encoded.sparkSession
    rng = np.random.default_rng(seed)
    width, rows_in_block = KEPT + 16, 256
    basis = rng.standard_normal((HASHED, width)).astype(np.float32)
    chosen = written(encoded.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= int(min(1.0, sample / max(n, 1)) * (1 << 20))).repartition(tasks, "id"), "leak-sample")
    size, step = 24, 12

    def total(group: pd.DataFrame) -> pd.DataFrame:
        z = sum(np.frombuffer(b, np.float64) for b in group["data"])
        return pd.DataFrame({"block": group["block"].iloc[:1], "data": [z.tobytes()]})

    for _ in range(passes):
        shared = spark.sparkContext.broadcast((weights[:, None] * basis).astype(np.float32))

        def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p = shared.value
            out = np.zeros((HASHED, width))
            held: list = []

            def flush():
                if held:
                    _add_rows(out, np.concatenate([h[0] for h in held]), np.vstack([h[1] for h in held]))
                    held.clear()

            for batch in batches:
                for w in batch["w"]:
                    x = _features(w)
                    at = _windows(x, size, step)
                    y = _sums(p[x], at, size)
                    c = np.r_[0, np.cumsum(weights[x] ** 2)]  # squared length, words taken as different
                    y /= np.maximum(c[np.minimum(at + size, len(x))] - c[at], 1e-9)[:, None]
                    # every word gets the sum of the passages that cover it
                    edge = np.zeros((len(x) + 1, width), np.float32)
                    np.add.at(edge, at, y)
                    np.add.at(edge, np.minimum(at + size, len(x)), -y)
                    held.append((x, np.cumsum(edge[:-1], axis=0)))
                    if len(held) >= 200:
                        flush()
            flush()
            out *= weights[:, None]
            parts = out.reshape(-1, rows_in_block * width)
            yield pd.DataFrame({"block": np.arange(len(parts)), "data": [x.tobytes() for x in parts]})

        summed = chosen.select("w").mapInPandas(product, "block int, data binary").groupBy("block").applyInPandas(
            total, "block int, data binary").toPandas()  # HASHED rows in all, whatever the corpus
        z = np.zeros((HASHED // rows_in_block, rows_in_block * width))
        for b, data in zip(summed["block"], summed["data"]):
            z[b] = np.frombuffer(data, np.float64)
        u, _, _ = np.linalg.svd(z.reshape(HASHED, width), full_matrices=False)
        basis = u.astype(np.float32)
        shared.unpersist()
    return basis[:, :KEPT]


#: Index of the item passages: tables, hyperplanes per table, least sure planes that a query may miss.
TABLES, PLANES, UNSURE = 6, 18, 5


def hyperplanes(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((KEPT, TABLES * PLANES)).astype(np.float32)


def _keys(side: np.ndarray) -> np.ndarray:
    """(rows, TABLES) keys of the sides on which vectors lie of all hyperplanes."""
    bits = (side > 0).reshape(len(side), TABLES, PLANES)
    return bits @ (1 << np.arange(PLANES))


class _Index:
    """Latent passages of one length and their owners, by the keys of every table.  A
    passage stands under its own key and those that differ in one or two of its
    ``UNSURE`` planes that it is nearest to.  The planes pass through the middle of the
    passages, so that the keys are spread."""

    def __init__(self, vectors: np.ndarray, own: np.ndarray, at: np.ndarray, planes: np.ndarray):
        self.vectors, self.own, self.at = vectors, own, at
        self.middle = vectors.mean(axis=0) @ planes
        side = vectors @ planes - self.middle
        keys = _keys(side)
        near = np.argsort(np.abs(side).reshape(len(side), TABLES, PLANES), axis=2)[:, :, :UNSURE]
        flips = [0 * near[:, :, 0]] + [1 << near[:, :, i] for i in range(UNSURE)]
        flips += [(1 << near[:, :, i]) | (1 << near[:, :, j]) for i in range(UNSURE) for j in range(i)]
        self.first, self.rows = [], []
        for t in range(TABLES):
            k = np.concatenate([keys[:, t] ^ f[:, t] for f in flips])
            order = np.argsort(k, kind="stable")
            self.first.append(np.searchsorted(k[order], np.arange((1 << PLANES) + 1)).astype(np.int32))
            self.rows.append((order % len(keys)).astype(np.int32))

    def near(self, v: np.ndarray, planes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``v`` and of the index with a cosine of at least ``threshold``, of those that meet in a table."""
        keys = _keys(v @ planes - self.middle)
        near = [np.empty(0, np.int64)]
        for t in range(TABLES):
            first = self.first[t]
            start = first[keys[:, t]]
            n = first[keys[:, t] + 1] - start
            x = np.repeat(np.arange(len(v)), n)
            y = self.rows[t][np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            for k in range(0, len(x), 100_000):  # bounded memory
                i, j = x[k : k + 100_000], y[k : k + 100_000]
                keep = np.einsum("ij,ij->i", v[i], self.vectors[j]) >= threshold
                near.append(i[keep].astype(np.int64) * len(self.own) + j[keep])
        return np.divmod(_distinct(np.concatenate(near)), len(self.own))


class _Items:
    """One block of test items prepared for search."""

    def __init__(self, ids, coded, answers, terms: np.ndarray, planes: np.ndarray, share: float, rule: "Copies | Paraphrases"):
        self.ids = np.array(ids, np.int64)
        self.words = [np.frombuffer(w, np.uint32) for w in coded]
        self.answers = [np.frombuffer(a, np.uint32) if a else np.empty(0, np.uint32) for a in answers]
        self.need = [math.ceil(len(w) * share) for w in self.words]
        scale = [max([k for k, p in enumerate(PASSAGES) if n >= p + p // 2 - 1], default=0) for n in self.need]
        self.scales = []
        for k, size in enumerate(PASSAGES):
            own, vec, at = [], [], []
            for i, w in enumerate(self.words):
                if scale[i] == k and len(w):
                    start = _windows(w, size, size // 8)
                    vec.append(_sums(terms[(w & np.uint32(HASHED - 1)).astype(np.int64)], start, size))
                    own += [i] * len(start)
                    at.append(start)
            if own:
                self.scales.append((size, _Index(_unit(np.vstack(vec)), np.array(own), np.concatenate(at), planes)))
        # runs of the rule's length of all items, sorted, with the items that have each
        grams = [np.unique(_runs(w, rule.run)) for w in self.words]
        own = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        run = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(run, kind="stable")
        self.run_items = own[order]
        self.runs, self.run_first = np.unique(run[order], return_index=True)
        self.run_count = np.diff(np.r_[self.run_first, len(order)])
        self.sorted_runs = []
        for w in self.words:
            r = _runs(w, rule.run)
            order = np.argsort(r, kind="stable")
            self.sorted_runs.append((r[order], order))
        self.least = np.array([rule.least(w, n) for w, n in zip(self.words, self.need)])

    def possible(self, runs: np.ndarray) -> np.ndarray:
        """Whether a document with these runs has as many different ones of each item as the rule asks for at the least."""
        r = _distinct(runs)
        at = np.minimum(np.searchsorted(self.runs, r), max(len(self.runs) - 1, 0))
        at = at[self.runs[at] == r] if len(self.runs) else at[:0]
        n = self.run_count[at]
        rows = np.repeat(self.run_first[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.bincount(self.run_items[rows], minlength=len(self.ids)) >= self.least


def _distinct(x: np.ndarray) -> np.ndarray:
    """The different values, sorted (for small arrays quicker than hashing)."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _runs(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words (none where the text is shorter)."""
    x = w.astype(np.uint64)
    h = np.zeros(max(len(x) - k + 1, 0), np.uint64)
    for i in range(k):
        h = (h ^ x[i : len(x) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def common_stretch(item: np.ndarray, doc: np.ndarray, need: int, errors: float) -> bool:
    """Whether ``doc`` holds at least ``need`` successive words of ``item`` in one
    stretch with at most ``errors`` of them changed, added or dropped.

    For every number of errors e the recurrence keeps, per pair of positions, the
    earliest item word from which an alignment ending there can start.  Columns
    are document positions less e, so that all numbers of errors move at once."""
    n, m, most = len(item), len(doc), int(len(item) * errors)
    if n < need or m < need - most:
        return False
    far = np.int32(1 << 20)
    e = np.arange(most + 1)
    at = np.arange(-most, m + 1)[None, :] + e[:, None]  # document words read, per (e, column)
    word = np.where((at >= 1) & (at <= m), doc.astype(np.int64)[np.clip(at - 1, 0, max(m - 1, 0))], -1)
    outside = np.where((at >= 0) & (at <= m), np.int32(0), far)
    best = outside.copy()
    unlike = {int(w): np.where(word[:, 1:] == w, np.int32(0), far) for w in np.unique(item)}
    same = np.empty_like(best[:, 1:])
    for i in range(1, n + 1):
        new = outside + np.int32(i)
        np.add(best[:, :-1], unlike[int(item[i - 1])], out=same)
        np.minimum(new[:, 1:], same, out=new[:, 1:])
        if most:
            np.minimum(new[1:], best[:-1], out=new[1:])  # changed
            np.minimum(new[1:, :-1], best[:-1, 1:], out=new[1:, :-1])  # dropped
            np.minimum.accumulate(new, axis=0, out=new)  # added
            np.maximum(new, outside, out=new)
        if i >= need:
            length = i - new.min(axis=1)
            if ((length >= need) & (e <= length * errors)).any():
                return True
        best = new
    return False


def _straight(item: np.ndarray, doc: np.ndarray, shift: int, need: int, errors: float) -> bool:
    """The same without added or dropped words: item word i against document word i + shift."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi - lo < need:
        return False
    wrong = np.r_[0, np.cumsum(item[lo:hi] != doc[lo + shift : hi + shift])] - errors * np.arange(hi - lo + 1)
    return bool((wrong[need:] <= np.maximum.accumulate(wrong[: len(wrong) - need]) + 1e-9).any())


def _bag(item: np.ndarray, part: np.ndarray) -> int:
    """Words of ``part`` that the item has, each as often as in the item at most: no alignment has more."""
    a, n = np.unique(item, return_counts=True)
    b, m = np.unique(part, return_counts=True)
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int(np.minimum(n[at], m)[a[at] == b].sum())


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two word lists."""
    best = np.zeros(len(b) + 1, np.int32)
    for w in a:
        new = best.copy()
        np.maximum(new[1:], best[:-1] + (b == w), out=new[1:])
        best = np.maximum.accumulate(new)
    return int(best[-1])


def _holds(part: np.ndarray, answer: np.ndarray) -> bool:
    """Whether the words of the answer stand in ``part`` in a row (an empty answer stands nowhere)."""
    n = len(answer)
    if n == 0 or n > len(part):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(part, n) == answer).all(axis=1).any())


class Copies:
    """The rule for exact and slightly edited copies: one stretch of ``need`` item words
    or more with the share ``errors`` of them wrong at most."""

    run = 2

    def __init__(self, errors: float):
        self.errors = errors

    def least(self, item: np.ndarray, need: int) -> int:
        """Pairs that the item repeats count once."""
        return self.pairs(len(item), need) - (max(len(item) - 1, 0) - len(np.unique(_runs(item, 2))))

    def pairs(self, n: int, need: int) -> int:
        """Pairs of successive words that any stretch has in common: of its own length less
        one, every error spoils two at most."""
        return min((k - 1 - 2 * int(k * self.errors) for k in range(need, n + 1)), default=0)

    def holds(self, items: "_Items", i: int, doc: np.ndarray, theirs: np.ndarray, places: np.ndarray) -> bool:
        item, need, (own, order) = items.words[i], items.need[i], items.sorted_runs[i]
        at = np.minimum(np.searchsorted(own, theirs), max(len(own) - 1, 0)) if len(own) else np.empty(0, np.int64)
        shared = np.flatnonzero(own[at] == theirs) if len(own) else at
        # only where enough of the pairs stand together can there be a stretch
        pairs, reach = self.pairs(len(item), need), len(item) + int(len(item) * self.errors)
        if pairs <= 0:
            return common_stretch(item, doc, need, self.errors)
        if len(shared) < pairs:
            return False
        dense = np.flatnonzero(shared[pairs - 1 :] - shared[: len(shared) - pairs + 1] < reach)
        if not len(dense):
            return False
        shifts, n = np.unique(shared - order[at[shared]], return_counts=True)
        if any(_straight(item, doc, int(d), need, self.errors) for d in shifts[np.argsort(-n)[:3]]):
            return True
        lo, hi = shared[dense] - len(item), shared[dense + pairs - 1] + len(item) + 2
        cut = np.flatnonzero(lo[1:] > np.maximum.accumulate(hi)[:-1]) + 1
        return any(common_stretch(item, doc[max(0, a.min()) : b.max()], need, self.errors) for a, b in zip(np.split(lo, cut), np.split(hi, cut)))


class Paraphrases:
    """The rule for an item told in other words: around a place where passages meet, the
    share ``common`` of the item's words in order, and the words of its answer."""

    run = 1

    def __init__(self, common: float):
        self.common = common

    def least(self, item: np.ndarray, need: int) -> int:
        return math.ceil(len(item) * self.common) - (len(item) - len(np.unique(item)))

    def holds(self, items: "_Items", i: int, doc: np.ndarray, theirs: np.ndarray, places: np.ndarray) -> bool:
        item, answer = items.words[i], items.answers[i]
        if not _holds(doc, answer):
            return False
        n, least = len(item), math.ceil(len(item) * self.common)
        for shift in np.unique(places // 16) * 16:
            part = doc[max(0, shift - n // 2) : shift + n + n // 2 + 16]
            if _holds(part, answer) and _bag(item, part) >= least and common_subsequence(item, part) >= least:
                return True
        return False


def _parts(coded: list[np.ndarray], most: int = 8_192) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Start and members of successive groups of texts with about ``most`` words at most (bounded memory)."""
    lo, held = 0, 0
    for k, w in enumerate(coded):
        if k > lo and held + len(w) > most:
            yield lo, coded[lo:k]
            lo, held = k, 0
        held += len(w)
    if coded:
        yield lo, coded[lo:]


def _searcher(items: "_Items", terms_b, planes: np.ndarray, threshold: float, rule: "Copies | Paraphrases"):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = terms_b.value
        for batch in batches:
            ids, coded = batch["id"].to_numpy(), [np.frombuffer(w, np.uint32) for w in batch["w"]]
            doc, item = [], []
            for lo, part in _parts(coded):
                # one running sum over all documents of the part; passages never cross a document
                end = np.cumsum([len(w) for w in part])
                sums = _running(terms[(np.concatenate(part) & np.uint32(HASHED - 1)).astype(np.int64)].astype(np.float32))
                met, place = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for size, index in items.scales:
                    at = [_windows(w, size, size // 2) for w in part]
                    of = np.repeat(np.arange(len(part)), [len(a) for a in at])
                    at = np.concatenate(at)
                    a = at + (end - [len(w) for w in part])[of]
                    x, y = index.near(_unit(sums[np.minimum(a + size, end[of])] - sums[a]), planes, threshold)
                    met.append(of[x] * len(items.ids) + index.own[y])
                    place.append(at[x] - index.at[y])
                met, place = np.concatenate(met), np.concatenate(place)
                order = np.argsort(met, kind="stable")
                met, place = met[order], place[order]
                pair, first = np.unique(met, return_index=True)
                last = np.r_[first[1:], len(met)]
                d, i = np.divmod(pair, max(len(items.ids), 1))
                runs = {int(k): _runs(part[k], rule.run) for k in np.unique(d)}
                able = {k: items.possible(r) for k, r in runs.items()}
                for p in range(len(pair)):
                    if able[d[p]][i[p]] and rule.holds(items, i[p], part[d[p]], runs[d[p]], place[first[p] : last[p]]):
                        doc.append(ids[lo + d[p]])
                        item.append(items.ids[i[p]])
            yield pd.DataFrame({"doc_id": np.array(doc, np.int64), "item_id": np.array(item, np.int64)})

    return search


def latent_terms(coded: DataFrame) -> np.ndarray:
    """Weight and latent place of every hashed word: HASHED x KEPT, whatever the corpus."""
    weights, n_docs = idf(coded)
    return (weights[:, None] * latent_basis(coded, weights, n_docs)).astype(np.float32)


def _search(documents: DataFrame, items: DataFrame, share: float, threshold: float, rule, block: int, basis=latent_terms) -> DataFrame:
    spark = documents.sparkSession
    coded = written(encode(documents.select(F.col("doc_id").alias("id"), "text")), "leak-words")
    terms, planes = basis(coded), hyperplanes()
    terms_b = spark.sparkContext.broadcast(terms)
    one = items.groupBy("item_id").agg(F.min(F.struct("text", *(["answer"] if "answer" in items.columns else []))).alias("r")).select("item_id", "r.*")
    own = encode(one.select(F.col("item_id").alias("id"), "text"))
    answer = encode(one.select(F.col("item_id").alias("id"), F.col("answer").alias("text"))).withColumnRenamed("w", "a") if "answer" in items.columns else None
    own = own.join(answer, "id", "left") if answer is not None else own.withColumn("a", F.lit(None).cast("binary"))
    own = written(own, "leak-items")
    blocks = math.ceil(own.count() / block)
    place = F.pmod(F.xxhash64("id"), F.lit(max(blocks, 1)))  # about ``block`` items each
    out = spark.createDataFrame([], "doc_id long, item_id long")
    for b in range(blocks):
        rows = own.where(place == b).toPandas()  # one block of queries
        held = _Items(rows["id"], rows["w"], rows["a"], terms, planes, share, rule)
        out = out.unionByName(coded.mapInPandas(_searcher(held, terms_b, planes, threshold, rule), "doc_id long, item_id long"))
    return out.distinct()


def leaks(documents: DataFrame, items: DataFrame, share: float = 0.5, errors: float = 0.1, threshold: float = 0.9,
          block: int = 2000, basis=latent_terms) -> DataFrame:
    """doc_id, item_id of every document that contains an item.

    ``documents``: doc_id, text; ``items``: item_id, text.  A document contains an
    item if it holds at least ``share`` of its words in one stretch, in order,
    with at most ``errors`` of them changed, added or dropped.  Candidates are the
    documents with a passage whose latent cosine with one of the item is at least
    ``threshold``.  Items are the query set; they are searched in blocks of about
    ``block`` against all documents.  Null ids, null and wordless texts give no row;
    repeated rows collapse, of differing rows of an item the least counts.
    """
    return _search(documents, items, share, threshold, Copies(errors), block, basis)


def paraphrases(documents: DataFrame, items: DataFrame, common: float = 0.4, threshold: float = 0.7, block: int = 2000, basis=latent_terms) -> DataFrame:
    """doc_id, item_id of every document that tells an item in other words.

    ``items``: item_id, text, answer.  A document does if a passage of it has a latent
    cosine of at least ``threshold`` with one of the item, and around that place it has
    at least the share ``common`` of the item's words in order, and the words of the
    answer.  Items without answer give no row; else as :func:`leaks`.
    """
    return _search(documents, items, 0.5, threshold, Paraphrases(common), block, basis)


def report(found: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per test item: number of documents with it, and of those that also hold its
    answer, word by word (letters and digits, whatever stands between the words)."""
    held = found.join(documents.select("doc_id", _flat(F.col("text")).alias("t")), "doc_id").join(
        items.groupBy("item_id").agg(F.min(F.struct("suite", "answer")).alias("r")).select("item_id", "r.suite", _flat(F.col("r.answer")).alias("a")), "item_id")
    answered = (F.length("a") > 2) & F.contains("t", F.col("a"))
    return held.groupBy("item_id", "suite").agg(F.count("*").alias("n_docs"), F.count(F.when(answered, 1)).alias("n_with_answer"))


def _flat(c):
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
