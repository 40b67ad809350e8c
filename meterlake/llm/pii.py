"""Personal data: base patterns, and more spans by weak supervision.

Candidates are found by their form alone. Labelers (the shape, a gazetteer or list of placeholders,
the context before, the mix of characters) vote on each. Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is for each kind, without labels; a logistic span classifier is then trained on the
estimates. Base spans always stay; the classifier adds spans of further kinds beside them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, written

BASE = ["email", "ip", "card", "phone"]
ADDED = ["secret", "person", "national_id", "iban"]
KINDS = BASE + ADDED

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")

# Words that speak for or against a candidate, and given names.
CUES = {
    "secret": ["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "key", "bearer"],
    "person": ["mr", "mrs", "ms", "dr", "prof", "contact", "name", "named", "from", "dear", "regards", "sincerely", "herr", "frau", "señor", "señora", "monsieur", "madame", "author", "signed", "by"],
    "national_id": ["ssn", "social", "security", "id", "number"],
    "iban": ["iban", "account", "konto", "cuenta", "compte"],
}
COUNTER_CUES = ["commit", "sha", "sha1", "sha256", "md5", "checksum", "version", "revision", "isbn", "order", "page", "license", "licence", "under", "university", "street", "institute"]
PLACEHOLDERS = ["example", "changeme", "placeholder", "xxxx", "your", "test", "dummy", "none", "null", "000000"]
# Common given names of English, Spanish, French, German, Italian and Polish speakers, from general knowledge.
GIVEN_NAMES = set(
    """adam agnes alan alba alberto alejandro alex alexander alice amelie amy ana andrea andreas andrew angela anja ann anna anne antoine antonio
    barbara beatriz benjamin bernd brian camille carla carlos carmen caroline catherine charles charlotte chiara chloe christian christine christopher claire claudia clara
    daniel david denis diana diego dominik dorota edward elena elisabeth elizabeth emily emma enrique eric eva ewa fabian felix fernando florian francesca francesco francisco frank franz
    gabriel george gerhard giulia giuseppe grace grzegorz guillaume hannah hans harry heike heinrich helen helena helga henri henry hugo ines ingrid irene isabel isabella
    jack jacques jakob james jan jane javier jean jennifer jessica joanna johanna john jonas jorge jose joseph juan judith julia julian julie jürgen karen karin karl katarzyna kate katharina kevin klaus
    laura laurent lea lena leo leon lisa louis louise lucas lucia ludwig luis luca luigi lukas maciej manuel marc marco margaret maria marie mario marion mark markus marta martin martina mary matteo matthew max michael michel miguel monika
    nadia natalia nicolas nicole nina olga oliver olivia oscar pablo patricia patrick paul paula paulo pedro peter petra philip philippe pierre piotr rachel rafael raul rebecca renate ricardo richard robert roberto rosa ruth
    samuel sandra sara sarah sebastian sergio silvia simon sofia sophie stefan stephanie stephen steven susan susanne sylvie teresa thomas tim tomasz ursula valentina vanessa veronica victor victoria vincent walter werner william wolfgang xavier yves zofia""".split()
)

_CANDIDATES = re.compile(
    r"(?P<assigned>(?i:token|secret|password|passwd|pwd|api[_-]?key)[\x20]?[=:][\x20]?[\"']?)(?P<secret>[A-Za-z0-9+/_-](?:\.{0,2}[A-Za-z0-9+/_-]){5,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?)"
    r"|(?<![A-Za-z0-9+/_-])(?P<jwt>eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*)"
    r"|(?<![A-Za-z0-9+/_-])(?P<long>[A-Za-z0-9+/_-]{24,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?)"
    r"|(?<![A-Za-z0-9-])(?P<national_id>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![A-Za-z0-9-])"
    r"|(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![A-Za-z0-9])"
    r"|(?<![^\W_])(?P<person>[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:[\x20-][A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)+)(?![^\W_])"
)
_SENTENCE_START = re.compile(r"(?:^|[.!?:]|\n)\s*\Z")
# Fixed value: lengths of hexadecimal digests, which are as often public as secret.
DIGEST_LENGTHS = (32, 40, 64)
_HEX = re.compile(r"[0-9a-f]{16,}\Z")


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    """As the pattern's leftmost matches; a run before an @ is looked at once, so no text takes quadratic time."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield "email", start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as in BASE."""
    out = list(_emails(text))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def votes(kind: str, value: str, before: str) -> tuple[int, int, int, int]:
    """Votes of the labelers: 1 for, -1 against, 0 no vote."""
    if kind == "secret":
        shape = 0 if not _HEX.match(value) or len(value) in DIGEST_LENGTHS else 1
    elif kind == "iban":
        shape = 1 if _mod97(value) else -1
    elif kind == "national_id":
        shape = -1 if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000" else 1
    else:
        shape = -1 if _SENTENCE_START.search(before) or len(value.split(" ")) > 3 else 0
    low = value.lower()
    if kind == "person":
        listed = 1 if low.split(" ")[0].split("-")[0] in GIVEN_NAMES else -1
    else:
        listed = -1 if any(p in low for p in PLACEHOLDERS) else 0
    near = re.findall(r"[a-zß-öø-ÿ_]+[0-9]*", before.lower())[-3:]
    context = 1 if any(w in CUES[kind] for w in near) else -1 if any(w in COUNTER_CUES for w in near) else 0
    digits = sum(c.isdigit() for c in value) / len(value)
    if kind == "secret":
        mix = 1 if _entropy(value) >= 3 and 0.1 < digits < 0.95 else -1 if digits == 0 else 0
    elif kind == "person":
        mix = -1 if len(set(low.split(" "))) < len(low.split(" ")) or any(len(w) < 3 for w in low.split(" ")) else 0
    else:
        mix = 1 if len(set(value)) > 5 else -1
    return shape, listed, context, mix


def feature_code(kind: str, value: str, before: str) -> int:
    """Kind, votes and size class as one number under 4 * 81 * 4."""
    code = ADDED.index(kind)
    for v in votes(kind, value, before):
        code = code * 3 + v + 1
    return code * 4 + (len(value) >= 12) + (len(value) >= 24) + (len(value) >= 40)


def candidate_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, feature code) of candidates that touch none of the spans taken; leftmost first, not overlapping.

    Of a secret that touches some, what lies beside them stays a candidate, with the code of the whole.
    """
    out, busy = [], sorted((s, e) for _, s, e in taken)
    i = 0
    for m in _CANDIDATES.finditer(text):
        name = m.lastgroup
        kind = "secret" if name in ("long", "jwt", "secret") else name
        start, end = m.span(name)
        while i < len(busy) and busy[i][1] <= start:
            i += 1
        touched, k = [], i
        while k < len(busy) and busy[k][0] < end:
            touched.append(busy[k])
            k += 1
        touched = [(s, e) for s, e in touched if e > start]
        if touched and kind != "secret":
            continue
        code = feature_code(kind, text[start:end], text[max(0, start - 32) : start])
        at = start
        for s, e in [*touched, (end, end)]:
            if s > at:
                out.append((kind, at, s, code))
            at = max(at, e)
    return out


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base array<struct>, candidates array<struct>) of each row of docs; a null text counts as empty."""
    span = "kind string, start int, end int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base = base_spans(text)
                more = candidate_spans(text, base)
                rows.append(([dict(kind=k, start=s, end=e) for k, s, e in base], [dict(kind=k, start=s, end=e, code=c) for k, s, e, c in more]))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "base": [r[0] for r in rows], "candidates": [r[1] for r in rows]})

    return id_and_text(docs, id_col, text_col).mapInPandas(run, f"doc_id long, base array<struct<{span.replace(' ', ':').replace(',:', ',')}>>, candidates array<struct<kind:string,start:int,end:int,code:int>>")


def _unpacked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, votes as 0 to 2, size class) of feature codes."""
    size, rest = codes % 4, codes // 4
    columns = []
    for _ in range(4):
        columns.append(rest % 3)
        rest = rest // 3
    return rest, np.stack(columns[::-1], axis=1), size


#: What is believed of labelers beforehand weighs as much as this share of a kind's candidates, and four more.
PRIOR = 0.01
#: Kind x labeler: how often a vote is taken to be right beforehand. Lists, context and checksums tell more than looks.
BELIEF = np.array([[0.6, 0.9, 0.9, 0.6], [0.7, 0.9, 0.9, 0.7], [0.95, 0.9, 0.9, 0.6], [0.95, 0.9, 0.9, 0.6]])


def reliabilities(codes: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation on counted vote patterns: (probability that each code is personal data, tables kind x labeler x class x vote).

    A labeler that abstains says nothing; the tables hold how often it votes against and for where it votes.
    """
    kind, vote, _ = _unpacked(codes)
    says = vote != 1
    post = 1 / (1 + np.exp(-((vote - 1) * np.log(BELIEF / (1 - BELIEF))[kind]).sum(axis=1)))
    tables = np.full((len(ADDED), 4, 2, 2), 0.5)
    for _ in range(rounds):
        new = np.zeros_like(post)
        for k in range(len(ADDED)):
            at = kind == k
            if not at.any():
                continue
            weight = np.stack([n[at] * (1 - post[at]), n[at] * post[at]])
            believed = 4 + PRIOR * n[at].sum()
            prior = (weight.sum(axis=1) + believed / 2) / (n[at].sum() + believed)
            score = np.log(prior)[:, None] + np.zeros((2, at.sum()))
            for j in range(4):
                for c in range(2):
                    # a labeler is taken to be better than chance before it has been seen
                    t = np.bincount(vote[at, j][says[at, j]] // 2, weights=weight[c][says[at, j]], minlength=2) + believed * np.abs([c - BELIEF[k, j], 1 - c - BELIEF[k, j]])
                    tables[k, j, c] = t / t.sum()
                    score[c] += np.where(says[at, j], np.log(tables[k, j, c][vote[at, j] // 2]), 0)
            new[at] = 1 / (1 + np.exp(np.clip(score[0] - score[1], -30, 30)))
        post = new
    return post, tables


def span_classifier(codes: np.ndarray, n: np.ndarray, post: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights of a logistic classifier on kind, votes by kind and size class, fitted to the estimates by gradient steps."""
    x = features(codes)
    w = np.zeros(x.shape[1])
    share = n / max(1, n.sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 4 * (x.T @ (share * (p - post)) + 1e-4 * w)
    return w


def features(codes: np.ndarray) -> np.ndarray:
    kind, vote, size = _unpacked(codes)
    one = np.eye(len(ADDED))[kind]
    return np.concatenate([one, (one[:, :, None] * (vote - 1)[:, None, :]).reshape(len(codes), -1), np.eye(4)[size]], axis=1)


def learn(candidates: DataFrame, threshold: float = 0.5) -> list[int]:
    """Feature codes that the trained classifier takes for personal data. The driver gathers a count for each code seen, 1296 at most."""
    counts = candidates.select(F.explode("candidates.code").alias("code")).groupBy("code").agg(F.count("*").alias("n")).toPandas()
    if not len(counts):
        return []
    codes, n = counts["code"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
    post, _ = reliabilities(codes, n)
    p = 1 / (1 + np.exp(-features(codes) @ span_classifier(codes, n, post)))
    return sorted(codes[p >= threshold].tolist())


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): arrays of struct<kind, start, end>, by start then kind; code points, end exclusive.

    Null and empty texts have empty arrays. Repeated rows stay; other columns are left out.
    """
    found = written(found_spans(docs, id_col, text_col), "spans")
    accepted = F.lit(learn(found)).cast("array<int>")
    added = F.filter("candidates", lambda c: F.array_contains(accepted, c["code"]))
    return found.select("doc_id", "base", F.transform(added, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end by start then kind as listed, comma-joined."""
    rank = F.lit(KINDS)
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span, base or added, replaced by its kind in brackets; null texts stay null, all columns stay."""
    found = written(found_spans(docs.select(F.lit(None).cast("long").alias("doc_id"), text_col), "doc_id", text_col).select("candidates"), "candidates")
    accepted = set(learn(found))

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            base = base_spans(text)
            spans = base + [(k, s, e) for k, s, e, c in candidate_spans(text, base) if c in accepted]
            out, at = [], 0
            for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                if s >= at:
                    out += [text[at:s], f"[{kind}]"]
                at = max(at, e)
            return "".join([*out, text[at:]])

        return texts.map(one, na_action=None)

    return docs.withColumn(text_col, replaced(F.col(text_col)))
