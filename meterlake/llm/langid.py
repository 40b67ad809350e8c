"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit a binary character n-gram classifier, fitted on counts
over all learning documents, tells whether a text is of the languages with that bit set.
Decoding adds up the bits' losses, weighted by how well a bit separates its two sides, and takes
the codeword of least loss; a text whose two nearest codewords are about as far is ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

UNKNOWN = "und"
#: n-grams fall into so many classes; a table row for each language and class is all the driver gathers.
DIMS = 1 << 14
#: How fast the score falls with the loss; the difference of losses below which a text is ambiguous.
SHARPNESS = 4.0
MARGIN = 0.2

_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letter


def grams(text: str) -> np.ndarray:
    """Classes of the 2- and 3-grams of the whole text in lower case, other characters than letters as a space; empty if no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    c = np.where(letter, codes, 32).astype(np.uint64)
    c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    two = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] * np.uint64(0x165667B19E3779F9) + c[2:] * np.uint64(0x27D4EB2F165667C5)
    both = np.concatenate([two, three])
    return ((both ^ (both >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50)).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: all splits in two for up to 5 languages, else seeded random ones."""
    if n < 2:
        return np.ones((n, 1), np.int64)
    if n <= 5:
        splits = [[1] + [1 if s >> i & 1 else -1 for i in range(n - 1)] for s in range((1 << (n - 1)) - 1)]
        return np.array(splits, np.int64).T
    draws = np.random.default_rng(7)
    tries = [np.where(draws.random((n, 10 * n.bit_length())) < 0.5, 1, -1) for _ in range(50)]
    tries = [t[:, np.abs(t.sum(axis=0)) < n] for t in tries]
    return max(tries, key=lambda t: min((t[i] != t[j]).sum() / t.shape[1] for i in range(n) for j in range(i)))


@dataclass
class LanguageCodes:
    """languages, codewords (language x bit), weights (class x bit), middle and spread of each bit's margin."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    middle: np.ndarray
    spread: np.ndarray

    @classmethod
    def fitted(cls, languages: list[str], counts: np.ndarray) -> LanguageCodes:
        """counts: language x class. Languages weigh equally, however many documents they have."""
        code = codewords(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True) if len(languages) else counts
        weights, middle, spread = [], [], []
        for bit in code.T if len(languages) > 1 else []:
            p, n = share[bit > 0].mean(axis=0), share[bit < 0].mean(axis=0)
            w = np.log(p / n)
            weights.append(w)
            middle.append((p @ w + n @ w) / 2)
            spread.append(max(1e-9, (p @ w - n @ w) / 2))
        return cls(languages, code, np.array(weights, np.float32).reshape(len(weights), DIMS).T.copy(), np.array(middle), np.array(spread))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, ambiguous); und, 0 and True if there is no letter or nothing was learned."""
        g = grams(text or "")
        if not len(g) or not self.languages:
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margin = (self.weights[g].mean(axis=0) - self.middle) / self.spread
        loss = np.exp(-np.clip(self.code * margin, -3, 3)) @ (self.spread / self.spread.sum())
        near = np.exp(-SHARPNESS * (loss - loss.min()))
        near /= near.sum()
        best = int(near.argmax())
        second = np.partition(loss, 1)[1]
        return self.languages[best], float(near[best]), bool(second - loss.min() < MARGIN)


def held_out(doc_id: Column) -> Column:
    """Whether a row isn't to be learned from: crc32 of the id as text leaves 1 by 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", most_languages: int = 512) -> LanguageCodes:
    """Fits on every row whose text and language aren't null; each task sums its own counts first.

    The driver gathers DIMS counts for each language. More than most_languages distinct values are
    an error: such a column doesn't hold languages.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                if len(g := grams(text)):
                    sums.setdefault(lang, np.zeros(DIMS, np.int64))
                    sums[lang] += np.bincount(g, minlength=DIMS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "gram": at.astype("int32"), "n": n[at]})

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    bounded_batches(rows)
    found = rows.select("lang").distinct().limit(most_languages + 1).count()
    if found > most_languages:
        raise ValueError(f"{lang_col} has over {most_languages} distinct values")
    counts = rows.mapInPandas(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    dense = np.zeros((len(languages), DIMS))
    dense[pd.Categorical(counts["lang"], languages).codes, counts["gram"].astype(int)] = counts["n"]
    return LanguageCodes.fitted(languages, dense)


def identify(docs: DataFrame, model: LanguageCodes, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous added (a column of docs of such a name gives way).

    Null, empty and letterless texts are und with score 0 and ambiguous. Repeated rows stay. The
    function is declared as nondeterministic so that a filter on its result doesn't run it twice.
    """

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    bounded_batches(docs)
    found = predict.asNondeterministic()(F.col(text_col).cast("string"))
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "ambiguous")]
    return docs.select(*[F.col(f"`{c}`") for c in kept], found.alias("_found")).select(*[F.col(f"`{c}`") for c in kept], "_found.*")
