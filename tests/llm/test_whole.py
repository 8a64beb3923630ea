"""Training-data operators where a cut would lose matches."""

import random
import textwrap

import pyarrow as pa
import pytest

from scriptorium.llm import html_text, licenses, line_dedup


def grams(line):
    return {line[i : i + 8] for i in range(max(len(line) - 7, 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_hot_template_family_loses_no_link(spark):
    """Lines of one template, near-equal in pairs only: each pair that shares a band is found, and no other."""
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    template, lines = letters(220), []
    for _ in range(120):
        own = letters(36)
        lines += [template + own + letters(16), template + own + letters(16)]
    rng.shuffle(lines)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    bands = {r["doc_id"]: set(r["bands"]) for r in line_dedup.line_classes(docs).collect()}
    sets = [grams(x) for x in lines]
    near = [(a, b) for b in range(len(lines)) for a in range(b) if jaccard(sets[a], sets[b]) >= 0.75]
    meeting = [(a, b) for a, b in near if bands[a] & bands[b]]
    assert len(meeting) > 60
    gone = {r["doc_id"] for r in line_dedup.dedup_lines(docs).collect() if r["n_removed"]}
    assert {b for _, b in meeting} <= gone <= {b for _, b in near}


@pytest.mark.parametrize("n", [150, 300])
def test_recall_of_bands_in_boilerplate_families(n):
    """Of the pairs of a family of boilerplate lines with a similarity of 0.75 or more at least 0.95 share a band; those are all settled exactly."""
    rng = random.Random(n)
    letters = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    base = [letters(rng.randint(3, 8)) for _ in range(58)]
    others = {p: [letters(6) for _ in range(3)] for p in rng.sample(range(58), 12)}
    lines = list(dict.fromkeys(" ".join(rng.choice(others[p]) if p in others and rng.random() < 0.5 else w for p, w in enumerate(base)) for _ in range(n)))
    bands = [set(b.tolist()) for b in line_dedup._Lines(pa.array(lines)).bands]
    sets = [grams(x) for x in lines]
    near = [(a, b) for b in range(len(lines)) for a in range(b) if jaccard(sets[a], sets[b]) >= 0.75]
    assert len(near) > 100
    assert sum(bool(bands[a] & bands[b]) for a, b in near) >= 0.95 * len(near)


def test_lines_of_rows_that_repeat_an_id(spark):
    """Rows of one doc_id with texts of other lengths lose only their own lines; no column name clashes."""
    line, other = "a line of boilerplate that stands in many texts", "some words that are found in one text only"
    rows = [(1, f"{line}\n{other}", 5, 6), (1, f"{other} and more of it\n\n{line}\n{line}", 5, 6), (1, line, 5, 6), (2, line, 5, 6), (None, line, 5, 6)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, __gone int, __id int"))
    assert out.columns == ["doc_id", "text", "__gone", "__id", "n_lines", "n_removed"]
    got = sorted((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in out.collect())
    assert got[0] == (0, line, 0) and got[-1] == (2, "", 1)
    # The first line numbers of doc_id 1 are one place: those at it stay, later ones go.
    assert [x for x in got if x[0] == 1] == sorted([(1, f"{line}\n{other}", 0), (1, f"{other} and more of it\n", 2), (1, line, 0)])


def test_license_separators_and_letters_are_free(spark):
    """Texts whose canonical form is known match, whatever stands between their words."""
    texts = ["All rights  reserved.", "ALL RIGHTS-RESERVED", "All rights\nreserved.", "This is free and unencumbered software released into the public\ndomain.", "All rights were reserved."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: (r["is_license"], r["licenses"]) for r in licenses.license_scan(docs).collect()}
    assert rows == {0: (True, "proprietary"), 1: (True, "proprietary"), 2: (True, "proprietary"), 3: (True, "Unlicense"), 4: (False, "")}


def test_usual_license_files_are_known(spark):
    """A LICENSE file with title, copyright line and the wrapped whole text is a licence; one with a changed word is none."""
    whole = {name: next(t for n, t in licenses.TEXTS if n == name and t.startswith("\n\n")) for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense")}
    titles = {"MIT": "MIT License", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Unlicense": "The Unlicense"}
    files = [(n, f"{titles[n]}\n\nCopyright (c) 2021, Some Body\nAll rights reserved.\n\n" + "\n".join(textwrap.fill(x, 72) for x in t.strip().split("\n"))) for n, t in whole.items()]
    files.append(("", files[0][1].replace("sublicense", "lend")))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(files)], "doc_id long, text string")
    rows = {r["doc_id"]: (r["is_license"], r["licenses"]) for r in licenses.license_scan(docs).collect()}
    assert [rows[i][0] for i in range(len(files))] == [bool(n) for n, _ in files]
    assert all(n in rows[i][1].split(",") for i, (n, _) in enumerate(files) if n)


def test_body_outside_a_teaser_article_is_kept():
    """The text of a page in a plain div is not lost to a related item in an <article>."""
    body = "This is the text of a page that has many of the words that are used in prose and it goes on for quite a while so that it is long enough to be taken as good text by the rules, which is what we want here to be sure."
    page = f"<body><div><h1>Title</h1><p>{body}</p><p>Short bit.</p></div><article><h2>Teaser</h2><p>Read this too.</p></article><div>Posted in news</div></body>"
    assert html_text.main_text(page) == f"Title\n{body}\nShort bit.\nTeaser\nRead this too."
