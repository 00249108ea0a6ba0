r"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The score of a word is the sum over all
its segmentations into pieces (forward algorithm), that of a text the product over its words, that of the answer its
share among the languages. Probabilities are learned by expectation maximisation (forward-backward) on word counts
of a sample of labelled documents: about ``SAMPLE`` for each language at most, drawn by a hash of the id; counts and
expectations are made by Spark tasks, the driver gets one number for each language and piece.

Words are runs of letters (``str.isalpha``), lower-cased, with a word-start mark. Those of ``LONGEST`` letters or more are
scored and learned from one by one, with sums scaled up on the way: the same sums, only in another order of work.

Defined cases: a null text, or one without letters, is ``und`` with score 0, and so is every text if nothing could be
learned; ties go to the first language by code point; a null id is not held out and never learned from; unlabelled rows
are not learned from; repeated rows each keep a row and each count in learning; an empty table gives no row; other
columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import fresh, materialize
from tessera.llm.pieces import SPACE, default_model, text_slices

SAMPLE = 3000
ROUNDS = 2
LONGEST = 40
SMOOTH = 0.1
MEMO = 400_000
_WORD = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Runs of letters; ``_WORD`` takes numerals such as those in superscript or in circles for letters, so these are cut out."""
    found = _WORD.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return "".join(c if c.isalpha() else " " for c in " ".join(found)).split()


class Pieces:
    """The vocabulary's lower-case pieces; numbers from 1, 0 is any character that is not a piece."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        good = sorted(p for p in found if (p == SPACE or p.removeprefix(SPACE).isalpha()) and len(p) <= LONGEST)
        self.number = {p: i + 1 for i, p in enumerate(good)}
        self.n = len(good) + 1
        self.most = max(map(len, good), default=1)

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, from, to, piece) of all pieces in the words, sorted by ``to``, and the words' lengths."""
        get, most = self.number.get, self.most
        w, a, b, p = [], [], [], []
        for i, word in enumerate(words):
            n = len(word)
            for e in range(1, n + 1):
                single = True
                for s in range(max(0, e - most), e):
                    k = get(word[s:e])
                    if k is not None:
                        w.append(i), a.append(s), b.append(e), p.append(k)
                        single &= s != e - 1
                if single:
                    w.append(i), a.append(e - 1), b.append(e), p.append(0)
        order = np.argsort(np.array(b, np.int64), kind="stable")
        return *(np.array(x, np.int64)[order] for x in (w, a, b, p)), np.fromiter(map(len, words), np.int64, len(words))


@lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    return Pieces(model)


def _sums(at: np.ndarray, x: np.ndarray, out: np.ndarray) -> None:
    """out[at] += x, rows with repeats."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    out[at[first]] += np.add.reduceat(x[order], first, axis=0)


def forward(arcs, prob: np.ndarray) -> np.ndarray:
    """alpha (words, positions, languages); prob is (pieces, languages)."""
    w, a, b, p, size = arcs
    alpha = np.zeros((len(size), int(size.max()) + 1, prob.shape[1]))
    alpha[:, 0] = 1
    bounds = np.searchsorted(b, np.arange(1, alpha.shape[1] + 1))
    for e in range(1, alpha.shape[1]):
        s = slice(bounds[e - 1], bounds[e])
        if s.start < s.stop:
            _sums(w[s], alpha[w[s], a[s]] * prob[p[s]], alpha[:, e])
    return alpha


def growth(word: str, prob: np.ndarray, model: str) -> Iterator[np.ndarray]:
    """By what the forward sums of one word of any length grow with each letter, for each language; only the last sums are held."""
    found = pieces(model)
    get, most = found.number.get, found.most
    alpha = [np.ones(prob.shape[1])]
    for e in range(1, len(word) + 1):
        here = [(a, get(word[e - len(alpha) + k : e])) for k, a in enumerate(alpha)]
        new = sum((a * prob[p] for a, p in here if p is not None), np.zeros(prob.shape[1]))
        if here[-1][1] is None:
            new = new + alpha[-1] * prob[0]
        yield new
        alpha = [a / new for a in alpha[-(most - 1) :]] if most > 1 else []
        alpha.append(np.ones(prob.shape[1]))


def long_score(word: str, prob: np.ndarray, model: str) -> np.ndarray:
    """Log of the forward sum of one word, for each language."""
    return sum(map(np.log, growth(word, prob, model)), np.zeros(prob.shape[1]))


def long_expected(word: str, counts: np.ndarray, prob: np.ndarray, model: str, out: np.ndarray) -> None:
    """Adds the expected piece counts of one word. A piece's chance is its own times that of a border at its end, divided by the growth."""
    found = pieces(model)
    get, most = found.number.get, found.most
    grown = np.array(list(growth(word, prob, model)))
    border = np.zeros((len(word) + 1, prob.shape[1]))
    border[-1] = 1
    for e in range(len(word), 0, -1):
        chance = border[e]
        for s in range(e - 1, max(0, e - most) - 1, -1):
            chance = chance / grown[s]
            p = get(word[s:e], 0 if s == e - 1 else None)
            if p is not None:
                border[s] += chance * prob[p]
                out[p] += counts * chance * prob[p]


def expected(words: list[str], counts: np.ndarray, prob: np.ndarray, model: str) -> np.ndarray:
    """Expected piece counts (pieces, languages) of words whose counts are (words, languages)."""
    arcs = pieces(model).arcs(words)
    w, a, b, p, size = arcs
    alpha = forward(arcs, prob)
    beta = np.zeros_like(alpha)
    beta[np.arange(len(size)), size] = 1
    bounds = np.searchsorted(b, np.arange(1, alpha.shape[1] + 1))
    out = np.zeros_like(prob)
    whole = alpha[np.arange(len(size)), size]
    for e in range(alpha.shape[1] - 1, 0, -1):
        s = slice(bounds[e - 1], bounds[e])
        if s.start < s.stop:
            through = prob[p[s]] * beta[w[s], e]
            _sums(p[s], counts[w[s]] * alpha[w[s], a[s]] * through / whole[w[s]], out)
            flat = beta.reshape(-1, beta.shape[2])
            _sums(w[s] * beta.shape[1] + a[s], through, flat)
    return out


def _normal(counts: np.ndarray) -> np.ndarray:
    counts = counts + SMOOTH
    return counts / counts.sum(axis=0)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: letter_runs(t.lower()))

    return run(text)


def learn(docs: DataFrame, model: str | None = None, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities (pieces, languages)) from labelled documents that are not held out."""
    path = model or default_model()
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    totals = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    langs = sorted(totals)
    n_pieces = pieces(path).n
    if not langs:
        return [], np.zeros((n_pieces, 0))
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, sample / totals[k]))) for k in langs))
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    number = F.create_map(*chain.from_iterable((F.lit(k), F.lit(i)) for i, k in enumerate(langs)))
    words = drawn.select(number[F.col("lang")].alias("l"), F.explode(words_of(F.col("text"))).alias("word"))
    counts = materialize(words.groupBy("word", "l").agg(F.count("*").alias("n")).repartition("word"), "word_counts")
    prob = _normal(np.ones((n_pieces, len(langs))))
    for _ in range(ROUNDS):
        prob = _normal(_expectation(counts, prob, path))
    return langs, prob


def _expectation(counts: DataFrame, prob: np.ndarray, path: str) -> np.ndarray:
    shared = counts.sparkSession.sparkContext.broadcast(prob)  # vocabulary x languages: fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros_like(shared.value)
        for batch in batches:
            for i in range(0, len(batch), 8192):
                part = batch[i : i + 8192]
                n = np.zeros((len(part), total.shape[1]))
                n[np.arange(len(n)), part["l"]] = part["n"]
                words, long = [SPACE + w for w in part["word"]], (part["word"].str.len() >= LONGEST).to_numpy()
                if not long.all():
                    total += expected([words[k] for k in np.flatnonzero(~long)], n[~long], shared.value, path)
                for k in np.flatnonzero(long):
                    long_expected(words[k], n[k], shared.value, path, total)
        p, lang = np.nonzero(total)
        yield pd.DataFrame({"p": p, "l": lang, "n": total[p, lang]})

    out = np.zeros_like(prob)
    for r in counts.mapInPandas(run, "p int, l int, n double").groupBy("p", "l").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.p, r.l] = r.n
    return out


class _Scores:
    """Log scores of words, remembered up to MEMO of them."""

    def __init__(self, prob: np.ndarray, model: str):
        self.prob, self.model = prob, model
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, self.prob.shape[1]))

    def know(self, found: list[list[str]]) -> None:
        """Score the words of some texts that are not remembered."""
        words = set().union(*found)
        new = words - self.row.keys()
        if len(self.row) + len(new) > MEMO:
            self.clear()
            new = words
        self.add(list(new))

    def add(self, words: list[str]) -> None:
        need = len(self.row) + len(words)
        if need > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(need, 2 * len(self.table)) - len(self.table), self.table.shape[1]))])
        for i in range(0, len(words), 8192):
            part = words[i : i + 8192]
            short = [w for w in part if len(w) < LONGEST]
            arcs = pieces(self.model).arcs([SPACE + w for w in short])
            at = len(self.row)
            if short:
                self.table[at : at + len(short)] = np.log(forward(arcs, self.prob)[np.arange(len(short)), arcs[4]])
            long = [w for w in part if len(w) >= LONGEST]
            for k, w in enumerate(long, at + len(short)):
                self.table[k] = long_score(SPACE + w, self.prob, self.model)
            self.row.update(zip(chain(short, long), range(at, at + len(part))))


def predict(text: Column, langs: list[str], prob, model: str) -> Column:
    """struct(lang, score); ``prob`` is a broadcast of the probabilities."""
    here: dict[str, _Scores] = {}

    @F.pandas_udf("struct<lang:string,score:double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = here.setdefault("scores", _Scores(prob.value, model))
        for batch in batches:
            out = []
            for part in text_slices(batch):
                found = [letter_runs(t.lower()) if langs else [] for t in part]
                scores.know(found)
                for words in found:
                    if not words:
                        out.append(("und", 0.0))
                        continue
                    total = scores.table[np.fromiter(map(scores.row.__getitem__, words), np.int64, len(words))].sum(axis=0)
                    best = int(total.argmax())
                    out.append((langs[best], float(1 / np.exp(total - total[best]).sum())))
            yield pd.DataFrame(out, columns=["lang", "score"])

    return run(text)


def _found(docs: DataFrame, model: str | None, sample: int) -> Column:
    path = model or default_model()
    langs, prob = learn(docs, path, sample)
    return predict(F.col("text"), langs, docs.sparkSession.sparkContext.broadcast(prob), path)


def identify(docs: DataFrame, model: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """The documents with ``lang_pred`` and ``score`` (in place of columns of these names); learned from the same table's labels."""
    at = fresh(docs, "_found")
    df = docs.withColumn(at, _found(docs, model, sample)).drop("lang_pred", "score")
    return df.withColumns({"lang_pred": F.col(at)["lang"], "score": F.col(at)["score"]}).drop(at)


def known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents in one of the learned languages, as they are; those without letters, or undecided below ``least``, go."""
    at = fresh(docs, "_found")
    df = docs.withColumn(at, _found(docs, None, SAMPLE))
    return df.where((F.col(at)["lang"] != "und") & (F.col(at)["score"] >= least)).drop(at)


def op8(docs: DataFrame) -> DataFrame:
    return identify(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
