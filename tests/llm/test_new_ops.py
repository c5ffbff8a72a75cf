"""Personal data, periodic runs and the manifest against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanecraft.llm import merkle, periodic, pii
from lanecraft.llm import queries as Q
from lanecraft.llm.common import prepare, read
from tests.llm.util import DOCS, WORD, table

SF = "/root/testdata/sf0.01"
ODD = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, key string, runs int, row int, kept boolean"


def frame(spark, rows, schema=DOCS):
    prepare(spark)
    return spark.createDataFrame(rows, schema)


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


# ── personal data ────────────────────────────────────────────────────────────

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    """The base by the plain expressions."""
    out = []
    for k, form in enumerate(FORMS.values()):
        for m in re.finditer(form, text):
            d = re.sub("[^0-9]", "", m[0])
            odd = [int(c) for c in d[::-1]]
            check = sum(odd[::2]) + sum(sum(divmod(2 * x, 10)) for x in odd[1::2])
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or
                    k == 2 and 14 <= len(d) <= 19 and check % 10 == 0 or k == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def check_base(rows, texts):
    names = list(FORMS)
    for r in rows:
        found = plain_base(texts[r.doc_id] or "")
        joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in found)
        assert [r[f"n_{k}"] for k in names] == [sum(x[1] == i for x in found) for i in range(4)]
        assert r.base_sha256 == sha(joined)
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_base_forms_on_random_texts():
    rng = random.Random(4)
    bits = ["a", "1", "2", "55", ".", "@", "-", "+", " ", "(", ")", "b.c", "_", "x@y.z", "1.2.3.4", "4111111111111111", "+1 555", "é", "256.1.1.1"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 30)))
        assert pii.base(text) == plain_base(text), text


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000, "1 " * 100_000, "+1" * 50_000, "a@" * 50_000, "1.1." * 50_000, "@" * 50_000, "0" * 5000 + "1.2.3.4"])
def test_long_runs_stay_linear(text):
    known = pii.base(text)
    pii.candidates(text, known)


def test_personal_data_of_the_table(spark):
    docs = table(SF, "documents")
    rows = Q.op11_contextual_pii(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs.doc_id)
    check_base(rows, dict(zip(docs.doc_id, docs.text)))


def letters(rng):
    return "".join(rng.choice("aeiounrst") for _ in range(rng.randrange(2, 8)))


def planted(rng):
    """Texts with a telling phrase before phones; some phones there and elsewhere have no plus sign."""
    rows = []
    for i in range(300):
        words = [letters(rng) for _ in range(30)]
        if i < 40:
            words[10:10] = ["Call", "me", "on", f"+1 ({i:03}) 555-{7000 + i}"]
        elif i < 50:
            words[10:10] = ["call", "ME", "on", f"(0{300 + i}/{5550000 + i}"]
        elif i < 60:
            words[10:10] = ["batch", "number", f"0{300 + i}/{5550000 + i}"]
        rows.append((i, " ".join(words)))
    return rows


def test_patterns_find_unseen_identifiers(spark):
    rows = planted(random.Random(7)) + [(None, None), (None, ""), (45, "x")]
    df = frame(spark, rows, "doc_id long, text string")
    got = pii.personal_data(df).collect()
    assert len(got) == len(rows)
    assert sorted(r.doc_id for r in got if r.n_added) == list(range(40, 50))
    for r in got:
        if r.n_added:
            kind, a, b = r.spans.split(":")
            assert kind == "phone" and dict(rows[:300])[r.doc_id][int(a):int(b)] == f"0{300 + r.doc_id}/{5550000 + r.doc_id}"
    assert all(r.spans == "" and r.base_sha256 == sha("") for r in got if r.doc_id is None)


def test_copies_make_no_pattern(spark):
    one = "Call me on +1 (555) 555-7000 now"
    rows = [(i, one) for i in range(50)] + [(90, "call me on 0555/5550000 now")]
    assert all(r.n_added == 0 for r in pii.personal_data(frame(spark, rows, "doc_id long, text string")).collect())


def test_common_words_are_no_pattern(spark):
    rows = [(i, f"the cat of the dog on +1 (555) 555-{7000 + i} the mat on the sofa on a day on top") for i in range(20)] + [(90, "it is on 0555/5550000 now")]
    assert all(r.n_added == 0 for r in pii.personal_data(frame(spark, rows, "doc_id long, text string")).collect())


def test_scores_equal_a_plain_version(spark):
    rng = random.Random(2)
    edges = {(f"p{rng.randrange(6)}", rng.randrange(2), bytes([rng.randrange(30)]), rng.random() < 0.5): rng.randrange(1, 4) for _ in range(120)}
    for p, k, i, s in list(edges):  # an instance of a kind is either a seed or not
        if not s and any((q, k, i, True) in edges for q in [f"p{x}" for x in range(6)]):
            del edges[p, k, i, s]
    totals = {f"p{x}": 20 + 9 * x for x in range(6)}
    conf, belief = {}, {}
    for _ in range(pii.ROUNDS):
        conf = {}
        for (p, k, i, s), n in edges.items():
            conf[p, k] = conf.get((p, k), 0) + n * (1 if s else belief.get((k, i), 0)) / (totals[p] + 1)
        doubt = {}
        for (p, k, i, s) in edges:
            if not s and conf[p, k] >= pii.FLOOR:
                doubt[k, i] = doubt.get((k, i), 1) * (1 - min(conf[p, k], 0.999))
        belief = {x: 1 - d for x, d in doubt.items()}
    a, b = pii.confident(frame(spark, [(*e, n) for e, n in edges.items()], "pattern string, kind int, inst binary, seed boolean, n long"),
                         frame(spark, list(totals.items()), "pattern string, total long"))
    assert {(r.pattern, r.kind): pytest.approx(r.confidence) for r in a.collect()} == conf
    assert {(r.kind, bytes(r.inst)): pytest.approx(r.belief) for r in b.collect()} == belief


def test_pattern_counts_in_slices(spark, monkeypatch):
    rows = planted(random.Random(7))
    df = frame(spark, rows, "doc_id long, text string")
    want = frame(spark, [("me on",), ("on",), ("call me",), ("batch number",)], "pattern string")
    once = {tuple(r) for r in pii.occurrences(df, "text", want).collect()}
    monkeypatch.setattr(pii, "SLICE", 1)
    assert {tuple(r) for r in pii.occurrences(df, "text", want).collect()} == once
    assert once == {("me on", 50), ("on", sum((" " + t + " ").count(" on ") - t.endswith(" on") for _, t in rows)), ("call me", 50), ("batch number", 10)}


# ── periodic runs ────────────────────────────────────────────────────────────

def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(words, h):
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    return (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{a},{b},{q}\n" for a, b, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def my_runs(words, core):
    ids = periodic.numbers([str(x).encode() for x in words])
    found = []
    for a, b, low, high in periodic.tiles(len(ids), core):
        found += [(q, x + a, y + a) for q, x, y in periodic.fragments(np.concatenate([ids[a:b].astype(np.int64), [-2]]), low, high)]
    return sorted(((lo, hi - lo + q, q) for q, lo, hi in periodic.merged(found) if hi - lo + q >= max(6, 4 * q)), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words_in_tiles_of_any_size():
    rng = random.Random(5)
    for _ in range(1500):
        n, kinds = rng.choice([0, 1, 5, 6, 7, 12, 30, 60, 120, 200]), rng.choice([1, 2, 2, 3, 5, 50])
        words = [rng.randrange(kinds) for _ in range(n)]
        if n > 10 and rng.random() < 0.7:
            start = rng.randrange(n)
            words = periodic.wrapped(words, start, 1 + (n - start) // rng.choice([3, 4, 5, 9]))
            if rng.random() < 0.5:
                words[rng.randrange(n)] = 99
        assert my_runs(words, rng.choice([16, 32, 64, 1 << 13])) == plain_runs(words), words


def test_z_function():
    rng = random.Random(1)
    for _ in range(300):
        x = [rng.randrange(2) for _ in range(rng.randrange(1, 40))]
        want = [0] + [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(1, len(x))]
        assert periodic.z_function(x, 100) == want and periodic.z_function(x, 3) == [min(3, z) for z in want]


def check_runs(rows, texts):
    for r in rows:
        words = WORD.findall(texts[r.doc_id] or "")
        h = None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode())
        assert tuple(r)[1:8] == plain_row(words, h), r.doc_id


def test_periodic_runs_of_the_table(spark):
    docs = table(SF, "documents")
    texts = {i: t for i, t in zip(docs.doc_id, docs.text) if len(t) < 8000}
    rows = Q.op12_periodic_runs(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs.doc_id)
    check_runs([r for r in rows if r.doc_id in texts], texts)


def test_long_documents_are_tiled_and_stitched(spark):
    rng = random.Random(9)
    texts = {}
    for i in range(60):
        words = [f"w{rng.randrange(30 if i % 2 else 3)}" for _ in range(rng.randrange(200, 900))]
        start = rng.randrange(100)
        texts[i] = " ".join(periodic.wrapped(words, start, rng.choice([1, 2, 3, 7, 20, 64, 150])) if i % 3 else words)
    df = frame(spark, list(texts.items()), "doc_id long, text string")
    found = periodic.periodic_runs(df, extra=periodic.checksum(), rule=periodic.folded, core=32, long_bytes=400)
    check_runs(found.drop("n_words").collect(), texts)


def test_periodic_runs_of_odd_rows(spark):
    text = " ".join(["ab", "cd"] * 9)
    rows = [(None, None), (None, ""), (None, text), (1, text), (1, text), (2, "x y"), (3, " a \x1c" * 9)]
    rows = [(i, t, None, None, None, "x", "k", 1, 2, True) for i, t in rows]
    got = periodic.periodic_runs(frame(spark, rows, ODD)).collect()
    assert sorted((r.doc_id or -1, r.n_runs) for r in got) == [(-1, 0), (-1, 0), (-1, 1), (1, 1), (1, 1), (2, 0), (3, 1)]
    assert [(r.start, r.length, r.period, r.exponent_milli) for r in got if r.doc_id == 1] == [(0, 18, 2, 9000)] * 2
    assert periodic.periodic_runs(frame(spark, [], DOCS)).count() == 0
    shown = periodic.periodic_runs(frame(spark, rows, ODD), with_text=True).where("doc_id = 1").first()
    assert shown.text == "ab cd"


# ── manifest ─────────────────────────────────────────────────────────────────

def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_leaf(r, lower=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), r[1]) if lower and r[1] is not None else r[1]
    return sha(*[field(v) for v in (r[0], r[3], r[2], r[4], text)])


def plain_manifest(rows):
    """Sorted result rows; ``rows`` as in DOCS."""
    def climb(nodes, paths):
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            for i, path in enumerate(paths):
                path.append((at[i] % 8, nodes[at[i] // 8 * 8: at[i] // 8 * 8 + 8]))
                at[i] //= 8
            nodes = [sha(*nodes[j:j + 8]) for j in range(0, len(nodes), 8)]
        return nodes[0]

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(plain_leaf(r))))
        paths = [[] for _ in own]
        trees.append((own, paths, climb([plain_leaf(r) for r in own], paths)))
    above = [[] for _ in langs]
    root = climb([t[2] for t in trees], above) if trees else None
    out = []
    for (own, paths, subroot), up in zip(trees, above):
        for r, path in zip(own, paths):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = plain_leaf(r, bad)
            for slot, run in path + up:
                now = sha(*[now if i == slot else x for i, x in enumerate(run)])
            proof = sha(*[x for slot, run in path + up for i, x in enumerate(run) if i != slot])
            out.append((r[0], plain_leaf(r), subroot, root, proof, now, now == root))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_manifest_of_the_table(spark):
    docs = read(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    want = order(plain_manifest([tuple(r) for r in docs.collect()]))
    assert order(Q.op13_merkle_manifest(spark, SF).collect()) == want
    assert {r[6] for r in want} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [2], [8], [9], [1, 1], [65, 1, 8], [1] * 9 + [3], [600, 5] + [1] * 70])
def test_manifest_of_trees_of_any_height(spark, sizes):
    rows = [(10 * i, f"Text {i}é", f"l{k:02}" if k else None, None if i % 3 else "s", i) for k, n in enumerate(sizes) for i in range(n)]
    df = frame(spark, rows)
    want = order(plain_manifest(rows))
    for crown in (merkle.CROWN_ROWS, 2):
        assert order(merkle.manifest(df, merkle.third(), crown_rows=crown).collect()) == want


def test_manifest_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", None, None, 0), (3, "A", "en", "s", 1), (3, "A", "en", "s", 1), (3, "B", "en", "s", 1),
            (0, "ÀB", "", "x", 2)] + [(7, "Same", "de", "s", 4)] * 30
    full = [(*r, "x", "k", 1, 2, True) for r in rows]
    assert order(merkle.manifest(frame(spark, full, ODD), merkle.third()).collect()) == order(plain_manifest(rows))
    empty = merkle.manifest(frame(spark, [], DOCS), merkle.third())
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") != "-1"
    assert all(r.verified for r in merkle.manifest(frame(spark, rows)).collect())
