import random
import textwrap

import pytest

from meterlake.llm.license import LEAST_COVERED, TEMPLATES, LicenseScanner, candidate_blocks, scan, wording

from .samples import docs


def test_every_template_is_found_in_text(spark):
    texts = [f"Some words before it.\n{t}\nand others behind, here." for _, t in TEMPLATES]
    found = {}
    for r in scan(docs(spark, [*texts, None, "", "no such words"], extra=True)).collect():
        assert texts[r.doc_id][r.start : r.end] == r.block
        found.setdefault(r.doc_id, []).append(r.license)
    for i, (name, _) in enumerate(TEMPLATES):
        assert name in found[i], (name, found[i])
    assert set(found) == set(range(len(TEMPLATES)))


def test_wording_decides():
    s = LicenseScanner()
    assert s.identify("This work is licensed under the GNU General Public License, version 3.")[0] == "GPL-3.0"
    assert s.identify("This work is licensed under the GNU General Public License, version 7.")[0] is None
    assert s.identify("Licensed under CC BY-NC 4.0.")[0] == "CC-BY-NC-4.0"
    name, reduction, covered, shown = s.identify("This text is licensed under the GNU General Public License, version 3.")
    assert name == "GPL-3.0" and shown == ["-work+text"] and 0 < reduction < 1 and covered < 1
    assert s.identify("The driving licence was lost in the river.")[0] is None


def test_blocks():
    assert candidate_blocks("") == [] and candidate_blocks("a. b\nc") == []
    text = "x. License one. y. z. license two.\n" + "q. " * 5 + "license"
    assert [text[a:b] for a, b in candidate_blocks(text)] == ["License one. y. z. license two.", "license"]


def spans(text):
    return [(text[a:b], name) for a, b, name, *_ in LicenseScanner().rows(text)]


def test_each_of_several_licences_is_found():
    mit, apache = "Licensed under the MIT License.", "Licensed under the Apache License, Version 2.0."
    assert spans(f"{mit} {apache}") == [(mit, "MIT"), (apache, "Apache-2.0")]
    assert spans(f"{mit}\nAll rights reserved.") == [(mit, "MIT"), ("All rights reserved.", "Proprietary")]
    assert spans(f"{apache}\n{apache}") == [(apache, "Apache-2.0")] * 2
    dual = "This is dual licensed under the MIT License and the Apache License, Version 2.0."
    assert {n for _, n in spans(dual)} == {"MIT", "Apache-2.0"}
    assert [n for _, n in spans("\n".join(t for _, t in TEMPLATES))] == [n for n, _ in TEMPLATES]
    assert spans(f"Copyright 2020 A. Person\n{mit}") == [("Copyright 2020 A.", None), (mit, "MIT")]


def test_prose_around_does_not_hide_a_licence():
    prose = " ".join(f"river{i} stone{i * 7} meadow{i % 13}" for i in range(60))
    mit, gpl = "Licensed under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    assert spans(f"{mit}\n{prose}\n{prose[::-1]}\n{gpl}") == [(mit, "MIT"), (gpl, "GPL-3.0")]
    assert spans(f"{prose} {mit[:-1]} {prose}") == [(mit[:-1], "MIT")]
    assert [n for _, n in spans(f"{prose} {gpl[:-2]}7 {prose}")] == [None]
    assert [n for _, n in spans(f"All of it {prose} rights {prose}\nreserved by licence")] == [None]


def test_many_licence_lines_take_linear_time():
    rows = list(LicenseScanner().rows("All rights reserved.\n" * 3000))
    assert len(rows) == 3000 and {r[2] for r in rows} == {"Proprietary"}


def shaped(template):
    """A template as it stands in files: wrapped, behind comment marks, in paragraphs."""
    for width in (60, 72, 78, 100):
        lines = textwrap.wrap(template, width)
        yield "\n".join(lines)
        yield "\n".join(f"// {x}" for x in lines)
    yield template.replace(". ", ".\n\n")


@pytest.mark.parametrize("number", range(len(TEMPLATES)))
def test_wrapped_templates_are_found_whole(number):
    name, template = TEMPLATES[number]
    for text in shaped(template):
        found = [r for r in LicenseScanner().rows(f"Some words of the river before it all.\n\n{text}\n\nand others behind, here.\nMore meadow.") if r[2]]
        assert [r[2] for r in found] == [name]
        assert found[0][4] > 0.95


def test_inserted_clauses_are_seen():
    mit = TEMPLATES[2][1]
    begin = "Permission is hereby granted, "
    assert mit.startswith(begin)
    for clause in ("but not to any commercial user without written agreement, ", "provided that you pay the author five euros on the first monday of each month and send flowers to my aunt who lives by the river and also likes a box of chocolates, "):
        for at in (len(begin), mit.index("to use, copy"), mit.index("THE SOFTWARE IS"), mit.index("OTHER DEALINGS IN")):
            assert not [n for _, n in spans(mit[:at] + clause + mit[at:]) if n == "MIT"], (clause, at)
    assert [n for _, n in spans(mit.replace("sublicense, and/or", "sublicense, and / or even"))] == ["MIT"]


def windows(text):
    """Brute force: licences that any window of words has, every template against every window."""
    scanner = LicenseScanner()
    own, found = wording(text), set()
    for number, (name, _, want) in enumerate(scanner.templates):
        width = len(want) + max(3, len(want) // 4)
        for i in range(len(own)):
            part = own[i : i + width]
            covered, _, same, _, put_in = scanner.aligned(part, number)
            if covered >= LEAST_COVERED and same and scanner.harmless([part[j] for j in put_in], number):
                found.add(name)
    return found


def test_as_all_templates_against_all_windows():
    rng = random.Random(6)
    short = [i for i, (_, t) in enumerate(TEMPLATES) if len(t) < 200]
    words = ["river", "stone", "meadow", "the", "of", "licence", "copyright", "under", "free", "version", "and", "2.0", "rights"]
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            t = TEMPLATES[rng.choice(short)][1].split(" ")
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(t))
                t[i : i + rng.randint(0, 1)] = rng.choices(words, k=rng.randint(0, 2))
            parts += [" ".join(rng.choices(words, k=rng.randint(0, 12))), "\n".join(textwrap.wrap(" ".join(t), 50))]
        text = "\n".join(parts)
        got, want = {n for _, n in spans(text) if n}, windows(text)
        assert got <= want
        # a template within a longer one of the same words isn't reported beside it
        assert {n for n in want - got if not any(set(wording(dict(TEMPLATES)[n])) <= set(wording(t)) for m, t in TEMPLATES if m in got)} == set(), text


def test_empty_table_repeats_and_long_texts(spark):
    assert scan(docs(spark, [])).count() == 0
    long = "meadow river stone. " * 60_000 + "Licensed under the MIT License.\n" + "meadow " * 200_000
    rows = spark.createDataFrame([(None, "All rights reserved."), (5, "All rights reserved."), (5, "All rights reserved."), (6, long)], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.license) for r in scan(rows).collect())
    assert found == [(0, "Proprietary"), (5, "Proprietary"), (5, "Proprietary"), (6, "MIT")]


def test_a_batch_without_any_block(spark):
    """It was an error: an empty column of lists has no type in pandas."""
    assert scan(docs(spark, ["no such words", "", None, "nor here"]).coalesce(1)).collect() == []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = scan(docs(spark, ["nothing"] * 5 + ["Licensed under the MIT License."] + ["nothing"] * 5).coalesce(1)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [(r.doc_id, r.license, r.differences) for r in found] == [(5, "MIT", [])]


def test_large_ids_beside_null_ones(spark):
    """They went through floating point: 2**53 + 1 came back as 2**53, and 2**63 - 1 was an error."""
    ids = [None, 2**53 + 1, 2**63 - 1, -(2**63)]
    rows = spark.createDataFrame([(i, "All rights reserved.") for i in ids], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in scan(rows).collect()} == set(ids)
