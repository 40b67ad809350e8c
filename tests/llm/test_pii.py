import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from meterlake.llm.pii import ADDED, BASE, base_spans, candidate_spans, detect, features, joined, luhn, redact, reliabilities, span_classifier

from .samples import HARD, docs

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("a@.b-0 129+()4é"), max_size=60))
def test_base_as_the_patterns(text):
    assert base_spans(text) == plain(text)


def test_samples():
    text = "x a.b+c@d-e.co.uk, 10.0.0.255 256.1.1.1, 4111 1111 1111 1111, +1 (555) 123-4567"
    assert [text[s:e] for _, s, e in base_spans(text)] == ["a.b+c@d-e.co.uk", "10.0.0.255", "4111 1111 1111 1111", "+1 (555) 123-4567"]
    assert base_spans("a" * 200_000 + "@") == [] and base_spans("1" * 100_000) == []


def test_weak_supervision_adds_secrets(spark):
    texts = [*HARD, *(f'word token = "{hashlib.sha1(bytes([i])).hexdigest()}" and a@b.com é' for i in range(30)), *(f"commit {'abcdefgh' * 4} done" for _ in range(20)), 'password=0f3a9b77c2d1e8', "IBAN GB82WEST12345698765432 here", "Contact Maria Lopez today"]
    rows = {r.doc_id: r for r in detect(docs(spark, texts, extra=True)).withColumn("s", joined_all()).collect()}
    kinds = {k for r in rows.values() for k in {x.kind for x in r.added}}
    assert {"secret", "iban"} <= kinds
    for i, r in rows.items():
        text = texts[i] or ""
        assert [(x.kind, x.start, x.end) for x in r.base] == plain(text)
        for x in r.added:
            assert not text[x.start : x.end].startswith("abcdefgh")
        if text.startswith("word token"):
            assert [text[x.start : x.end] for x in r.added] == [text[14:54]]
    clean = {r.doc_id: r.text for r in redact(docs(spark, texts)).collect()}
    assert clean[1] is None and clean[0] == "" and clean[8] == "hello world"[:0] + HARD[8]
    assert clean[len(HARD)] == 'word token = "[secret]" and [email] é'


def joined_all():
    from pyspark.sql import functions as F

    return joined(F.concat("base", "added"))


def test_empty(spark):
    assert detect(docs(spark, [])).count() == 0 and redact(docs(spark, [])).count() == 0


def test_long_secrets_leave_nothing_behind(spark):
    many = "".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(5))[:300]
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJ" + "c1R9" * 50 + ".Qk7" + "xY3_" * 10
    base64 = "Ab3" + "dE4/" * 60 + "+9=="
    key = "0f3a9b77c2d1e8"
    cases = [(f'token = "{many}"', many), (f"token: {jwt} end", jwt), (f"see {jwt} there", jwt), (f"the key {base64} ok", base64), (f"API_KEY={key}", key), (f"Password: {key}", key), (f"TOKEN={key}", key)]
    texts = [f"some words {t} é" for t, _ in cases] + [f'word token = "{hashlib.sha1(bytes([i])).hexdigest()}"' for i in range(40)]
    clean = {r.doc_id: r.text for r in redact(docs(spark, texts)).collect()}
    for i, (t, secret) in enumerate(cases):
        assert clean[i] == texts[i].replace(secret, "[secret]")


def test_a_secret_around_a_base_span_has_no_rest():
    text = 'token = "' + "ab12" * 40 + "." + "10.0.0.255" + "." + "cd34" * 40 + '"'
    base = base_spans(text)
    taken = sorted([(s, e) for _, s, e in base] + [(s, e) for _, s, e, _ in candidate_spans(text, base)])
    assert base and taken[0][0] == 9 and taken[-1][1] == len(text) - 1
    assert all(a[1] == b[0] for a, b in zip(taken, taken[1:], strict=False))


def test_candidates_take_linear_time():
    for c in ("a", "a.", "eyJ", "eyJa.", "token=", "="):
        candidate_spans(c * 100_000, [])


def test_em_recovers_planted_reliabilities():
    """Votes drawn with known reliabilities: what is estimated without labels comes near them, and so does the share of personal data."""
    rng = np.random.default_rng(1)
    right = np.array([[0.8, 0.7], [0.95, 0.9], [0.9, 0.85], [0.7, 0.75]])  # of those that vote, by class
    silent = np.array([0.5, 0.2, 0.3, 0.1])
    for kind, share in ((0, 0.3), (1, 0.1), (3, 0.6)):
        truth = (rng.random(300_000) < share).astype(int)
        code = np.full(len(truth), kind)
        for j in range(4):
            agrees = rng.random(len(truth)) < right[j][truth]
            code = code * 3 + np.where(rng.random(len(truth)) < silent[j], 1, 2 * (truth == agrees))
        codes, n = np.unique(code * 4 + rng.integers(0, 4, len(truth)), return_counts=True)
        post, tables = reliabilities(codes, n.astype(float))
        assert np.abs(tables[kind][:, 0, 0] - right[:, 0]).max() < 0.05 and np.abs(tables[kind][:, 1, 1] - right[:, 1]).max() < 0.05
        assert abs((post * n).sum() / n.sum() - share) < 0.04
        learned = 1 / (1 + np.exp(-features(codes) @ span_classifier(codes, n.astype(float), post)))
        assert ((learned >= 0.5) == (post >= 0.5))[n > 500].mean() > 0.9


def iban(rng):
    bban = "".join(rng.choices("0123456789", k=18))
    return f"DE{98 - int(bban + '131400') % 97:02d}{bban}"


def planted_texts(seed=2):
    """(text, kind, value or None) of prose with personal data, and of prose with what only looks like it."""
    rng = random.Random(seed)
    prose = lambda: " ".join(rng.choices(["river", "stone", "meadow", "and", "over", "the", "light"], k=rng.randint(5, 30)))
    hexed = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    rows = []
    for i in range(60):
        made = {
            "secret": (rng.choice(['token = "{}"', "password={}", "api_key: {}", "the key {} is"]), hexed(rng.choice([18, 40, 64]))),
            "person": (rng.choice(["contact {} today", "dear {}", "written by {} last", "asked {} for"]), f"{rng.choice(['Maria', 'Hans', 'Pierre', 'Laura', 'Robert'])} {rng.choice(['Lopez', 'Huber', 'Novak', 'Brown'])}"),
            "national_id": (rng.choice(["ssn {} of", "social security number {}"]), f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"),
            "iban": (rng.choice(["iban {} here", "account {} at"]), iban(rng)),
        }
        for kind, (form, value) in made.items():
            rows.append((f"{prose()} {form.format(value)} {prose()}", kind, value))
        rows.append((f"{prose()} commit {hexed(40)} {prose()}.", None, None))
        rows.append((f"{prose()}. {rng.choice(['Stone River', 'The Meadow', 'Apache License'])} {prose()}", None, None))
        rows.append((f"{prose()} order 000-00-{rng.randint(1, 9999):04d} {prose()}", None, None))
        rows.append((f"{prose()} part AB12{''.join(rng.choices('0123456789', k=14))} {prose()}", None, None))
    return rows


def test_recall_of_added_kinds(spark):
    rows = planted_texts()
    found = {r.doc_id: [(x.kind, rows[r.doc_id][0][x.start : x.end]) for x in r.added] for r in detect(docs(spark, [t for t, _, _ in rows])).collect()}
    for kind in ADDED:
        planted = [i for i, (_, k, _) in enumerate(rows) if k == kind]
        assert sum((kind, rows[i][2]) in found[i] for i in planted) >= 0.9 * len(planted), kind
    clean = [i for i, (_, k, _) in enumerate(rows) if k is None]
    assert sum(not found[i] for i in clean) >= 0.9 * len(clean)


def test_without_any_personal_data_nothing_is_added(spark):
    rows = [t for t, k, _ in planted_texts(3) if k is None and "AB12" not in t]
    assert detect(docs(spark, rows)).filter("size(added) > 0").count() <= 0.1 * len(rows)


def test_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a@b.com"), (None, "a@b.com"), (4, None), (4, "x 10.0.0.1")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.base)) for r in detect(df).collect()) == [(0, 1), (0, 1), (4, 0), (4, 1)]
