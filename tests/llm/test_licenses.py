import random
import re

import pytest

from paperproof.llm import licenses as L

from .cases import ODD, docs


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, threshold=0.9):
    out = []
    for doc_id, text, *_ in rows:
        w = words(text)
        hits = [(i, label) for p, label in L.PHRASES for q in [p.split()] for i in range(len(w)) if w[i : i + len(q)] == q]
        met = {}
        for label, t in L.TEMPLATES:
            t = set(words(t))
            for line in (text or "").split("\n"):
                if (c := len(t & set(words(line))) / len(t)) >= threshold - 1e-9:
                    met[label] = max(met.get(label, 0), c)
        base = {x for _, x in hits}
        at = [i for i, _ in hits]
        out.append((doc_id, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(met))), round(1.0 if hits else max(met.values(), default=0.0), 9)))
    return sorted(out, key=str)


def scan(spark, rows):
    return sorted(((*tuple(r)[:-1], round(r.score, 9)) for r in L.license_scan(docs(spark, rows)).collect()), key=str)


def test_odd_documents(spark):
    rng = random.Random(1)
    made = []
    for n in range(40):
        w = words(rng.choice(L.TEMPLATES)[1])
        for _ in range(rng.randint(0, 3)):
            w.pop(rng.randrange(len(w)))
        rng.shuffle(w)
        made.append((100 + n, "x y z\n" + " ".join(w) + (" MORE words" if n % 2 else "") + "\n" + "the of to " * 3))
    rows = [*ODD, *made, (50, "Under the MIT-license under the mit license CC BY-NC cc by nc 4.0"), (51, "under the mit\nlicense"), (52, "Apache License, Version 2.0"), (53, "apache license version 20")]
    assert scan(spark, rows) == brute(rows)
    assert scan(spark, []) == []


def test_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    assert sorted(((*tuple(r)[:-1], round(r.score, 9)) for r in L.license_scan(d).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_join_is_exact(spark, threshold):
    rng = random.Random(threshold)
    templates = tuple((f"l{k}", " ".join(rng.sample("abcdefghijklmnop", rng.randint(1, 9)))) for k in range(25))
    rows = [(i, " ".join(rng.sample("abcdefghijklmnopqrst", rng.randint(1, 12)))) for i in range(60)]
    got = {(r.doc_id, r.label) for r in L.license_spans(docs(spark, rows), templates=templates, threshold=threshold).collect()}
    want = {(i, label) for i, t in rows for label, x in templates if len(set(x.split()) & set(t.split())) >= threshold * len(set(x.split())) - 1e-9}
    assert got == want


def test_each_template_has_its_own_label_alone(spark):
    said = [(200 + i, label, text) for i, (label, text) in enumerate([*L.TEMPLATES, ("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3."), ("gpl-3,lgpl-3", L.TEMPLATES[4][1] + "\n" + L.TEMPLATES[7][1])])]
    got = {r.doc_id: r.labels for r in L.license_scan(docs(spark, [(i, text) for i, _, text in said]), apart=True).collect()}
    assert got == {i: label for i, label, _ in said}


def test_wrapped_notices(spark):
    rows = []
    for n, (label, text) in enumerate(L.TEMPLATES):
        w = text.split()
        for width in (3, 7, 12):
            rows.append((1000 * n + width, "some prose before\n" + "\n".join(" ".join(w[i : i + width]) for i in range(0, len(w), width)) + "\nand after it", label))
    rows.append((99_000, "Some book. All rights reserved.\nMore prose.", "proprietary"))
    got = {r.doc_id: r.labels for r in L.license_scan(docs(spark, [r[:2] for r in rows]), apart=True, wrapped=True).collect()}
    assert got == {i: label for i, _, label in rows}


def plain_runs(lines, sets):
    """Runs by their definition: from each first line on, line by line."""
    marks, out = {x.encode() for x in L.DISTINCT}, []
    for all_words, need, length in sets:
        own = all_words & marks
        good = lambda got: len(got) >= need and own <= got
        for i in range(len(lines)):
            got = all_words & set(lines[i])
            if not got or good(got):
                continue
            for j in range(i + 1, len(lines)):
                if sum(map(len, lines[i + 1 : j])) >= length:
                    break
                got |= all_words & set(lines[j])
                if good(got):
                    out.append((frozenset(got) | marks & set().union(*lines[i : j + 1])))
                    break
    return sorted(map(sorted, out))


def test_runs_are_the_shortest():
    rng = random.Random(5)
    for _ in range(400):
        pool = [b"a", b"b", b"c", b"d", b"nc", b"2", b"x", b"y"]
        lines = [rng.choices(pool, k=rng.choice([0, 0, 1, 2, 5])) for _ in range(rng.randint(0, 14))]
        sets = [(frozenset(rng.sample(pool[:6], k)), rng.randint(1, k), rng.randint(1, 6)) for k in (2, 3, 4, 5)]
        assert sorted(map(sorted, L.line_runs(lines, sets))) == plain_runs(lines, sets)


@pytest.mark.parametrize("text", ["license\n" * 100_000, "\n" * 200_000 + "permission\n" * 20_000, "license version 2\n\n\n" * 40_000, "the mit license under released x\n" * 20_000])
def test_long_texts_of_template_words_take_linear_time(text):
    import time

    sets = [(frozenset(x), max(1, -(-9 * len(set(x)) // 10)), len(x)) for _, t in L.TEMPLATES if (x := [w.encode() for w in words(t)])]
    lines = [L.plain_words(x) for x in text.split("\n")]
    began = time.process_time()
    for _ in L.line_runs(lines, sets):
        pass
    assert time.process_time() - began < 4


def registered(rows):
    """op8's labels by their definition: lines and runs of lines as blocks, distinguishing words asked for, what another template of a family covers left out."""
    marks, out = {x.encode() for x in L.DISTINCT}, []
    templates = [(label, frozenset(x.encode() for x in words(t)), len(words(t))) for label, t in L.TEMPLATES]
    for doc_id, text in rows:
        lines = [[x.encode() for x in words(line)] for line in (text or "").split("\n")]
        sets = [(t, -(-9 * len(t) // 10), n) for _, t, n in templates]
        met = {label for p, label in L.PHRASES for w, q in [(words(text), p.split())] if any(w[i : i + len(q)] == q for i in range(len(w)))}
        for block in [set(x) for x in lines] + [set(x) for x in plain_runs(lines, sets)]:
            good = [(label, t & marks) for label, t, _ in templates if len(t & block) >= 0.9 * len(t) - 1e-9 and t & marks <= block]
            met |= {label for label, own in good if not any(L.FAMILIES.get(x, x) == L.FAMILIES.get(label, label) and own < more for x, more in good)}
        out.append((doc_id, ",".join(sorted(met))))
    return sorted(out, key=str)


def test_registered_settings_by_their_definition(spark):
    from paperproof.llm.queries import op8_licenses

    rng, rows = random.Random(9), []
    for n in range(60):
        w = rng.choice(L.TEMPLATES)[1].split()
        for _ in range(rng.randint(0, 2)):
            w.pop(rng.randrange(len(w)))
        k = rng.randint(2, 9)
        rows.append((n, "\n".join(" ".join(w[i : i + k]) + rng.choice(["", "\n", " of x"]) for i in range(0, len(w), k)) + rng.choice(["", "\nAll rights\nreserved", "\nversion 2 of the GNU license"])))
    got = L.license_scan(docs(spark, rows), threshold=0.9, apart=True, wrapped=True)
    assert sorted(((r.doc_id, r.labels) for r in got.collect()), key=str) == registered(rows)
    table = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(((r.doc_id, r.labels) for r in op8_licenses(spark, "/root/testdata/sf0.001").collect()), key=str) == registered(table)
