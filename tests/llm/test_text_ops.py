"""Language ID, token counts, packing: against the libraries themselves and held-out labels."""

import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from lanecraft.llm import lang_id, packing, token_count
from lanecraft.llm import queries as Q
from lanecraft.llm.common import grouped, prepare
from tests.llm.util import DOCS, table

SF = "/root/testdata/sf0.01"
ODD = ["", None, " ", "\n\n", "a", "</s><s>[INST]", "<|endoftext|>x", "日本語 テキスト", "\U0001F600 \U0001F601", "a\tb  c　d", "ÇPA!! ÉO",
       "123 456", "x" * 5000, " " * 4000 + "x", "ab " * 30000, "▁▁a"]


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    rows = [(i, t, "en" if i % 2 else None, None, 0) for i, t in enumerate(ODD)] + [(0, "", None, "s", 1), (None, "no id", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("id", "n", "score", "lang_pred", "piece", "length", "n_tokens", "row", "bucket"):  # clashing names
        df = df.selectExpr("*", f"'x' as {c}")
    return df


# ── language ID ──────────────────────────────────────────────────────────────

def test_suffix_automaton_holds_exactly_the_substrings():
    rng = random.Random(1)
    text = bytes(rng.randrange(1, 4) for _ in range(60))
    t = lang_id.suffix_automaton(text, 4)

    def runs(word):
        s = 0
        for c in word:
            s = t[s][c]
            if s < 0:
                return False
        return True

    for _ in range(500):
        word = bytes(rng.randrange(1, 4) for _ in range(rng.randrange(1, 8)))
        assert runs(word) == (word in text)


def greedy_phrases(text, ref):
    """Longest-match phrases, one symbol at least, restarted at each lane."""
    n = 0
    for lane in range(0, len(text), lang_id.LANE):
        part, at = text[lane:lane + lang_id.LANE], 0
        while at < len(part):
            end = at + 1
            while end <= len(part) and part[at:end] in ref:
                end += 1
            at = max(at + 1, end - 1)
            n += 1
    return n


def test_phrase_counts_equal_greedy_longest_match():
    refs = {"a": b"abcabdab\0bacb", "b": b"zzyx\0yxzab"}
    parser = lang_id.Parser(refs)
    texts = ["abcab zzyx", "qq", "ab" * 1500, "yxz abd", ""]
    sym, off = lang_id.normalise(pa.array(texts))
    h = parser.entropies(sym, off)
    for i in range(len(texts)):
        own = sym[off[i]:off[i + 1]].tobytes()
        for k, lang in enumerate(parser.langs):
            want = greedy_phrases(own, refs[lang]) * parser.bits[k] / len(own) if own else np.inf
            assert h[i, k] == pytest.approx(want)


def test_language_accuracy_on_held_out_rows(spark):
    got = Q.op1_language_id(spark, SF).toPandas().merge(table(SF, "documents"), on="doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang_pred == held.lang).mean() > 0.97


def test_language_edge_rows(spark, odd):
    refs = lang_id.fit(odd)
    got = lang_id.predict(odd, refs, ["doc_id", "score"]).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        text = "no id" if r["doc_id"] is None else ODD[r["doc_id"]]
        if not text or not any(c.isalpha() for c in text):
            assert r["lang_pred"] == "und" and r[3] == 0.0
    assert lang_id.fit(odd.limit(0)) == ()
    assert {r["lang_pred"] for r in lang_id.predict(odd, (), ["doc_id"]).collect()} == {"und"}
    assert lang_id.predict(odd.limit(0), refs, ["doc_id"]).count() == 0


# ── token counts ─────────────────────────────────────────────────────────────

def test_token_counts_equal_the_library(spark):
    model, _ = token_count._model(P.path("piece_bpe_32k.model"))
    got = Q.op6_token_counts(spark, SF).toPandas().merge(table(SF, "documents"), on="doc_id")
    assert (got.n_tokens == [len(model.encode(t)) for t in got.text]).all()
    assert (got.n_bytes == [len(t.encode()) for t in got.text]).all() and (got.over_limit == (got.n_tokens > 4096)).all()


def test_spliced_counts_equal_whole_encoding():
    model, inner = token_count._model(P.path("piece_bpe_32k.model"))
    rng = random.Random(6)
    pool = ["the ", "tion", "\n", "  ", "é", "日本", "\U0001F600", "aaaa", "0123", "</s>", "_x_", " ", "\t", "▁"]
    for trial in range(120):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 400)))
        for chunk, overlap in ((40, 4), (64, 16), (7, 2)):
            assert token_count.count_tokens(text, model, inner, chunk, overlap) == len(model.encode(text)), text
    assert token_count.count_tokens("a" * 3000, model, inner, 100, 10) == len(model.encode("a" * 3000))


def test_token_count_edge_rows(spark, odd):
    model, _ = token_count._model(P.path("piece_bpe_32k.model"))
    got = token_count.token_counts(odd, P.path("piece_bpe_32k.model"), limit=3, chunk=1000).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        text = ("no id" if r["doc_id"] is None else ODD[r["doc_id"]]) or ""
        assert r["n_tokens"] == len(model.encode(text)) and r["n_bytes"] == len(text.encode()) and r["over_limit"] == (r["n_tokens"] > 3)
    assert token_count.token_counts(odd.limit(0), P.path("piece_bpe_32k.model")).count() == 0


# ── packing ──────────────────────────────────────────────────────────────────

def ids_of(text):
    from tokenizers import Tokenizer
    t = ids_of.__dict__.setdefault("tok", Tokenizer.from_file(P.path("byte_bpe_50k.json")))
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def check_packing(pieces, ids):
    """Every piece is where it says, pieces cover their document, sequences are gapless and not too long."""
    for doc, own in pieces.groupby("doc_id"):
        own = own.sort_values("piece")
        assert own.piece.tolist() == list(range(len(own)))
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids[doc])
        assert (own.length.iloc[1:] == packing.SEQ_LEN).all()
    for r in pieces.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= packing.SEQ_LEN


def test_packing_round_trip(spark):
    got = Q.op3_best_fit_packing(spark, SF).toPandas()
    docs = table(SF, "documents")
    assert set(got.doc_id) == set(docs.doc_id)
    check_packing(got, {i: ids_of(t) for i, t in zip(docs.doc_id, docs.text)})
    assert got.sequence_id.nunique() <= 1.01 * np.ceil(got.length.sum() / packing.SEQ_LEN)


def test_encoder_equals_the_library():
    encode = packing.encoder(P.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    pool = ["the ", "'s", "'LL", "\n", "  ", "é", "日本", "\U0001F600", "½", "0123", "<|endoftext|>", "_x_", " ", "\t", "　", "\x85", "\x1c", "!!"]
    for text in [t for t in ODD if t is not None] + ["".join(rng.choice(pool) for _ in range(60)) for _ in range(300)]:
        assert encode(text).tolist() == ids_of(text)[:-1].tolist(), text


def test_plan_uses_every_piece_once_and_finds_exact_complements():
    rng = np.random.default_rng(4)
    for size in (10, 64, 2048):
        for _ in range(8):
            lengths = rng.integers(1, size + 1, rng.integers(1, 400))
            counts = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)]))
            used: dict[int, int] = {}
            for own, n in packing.plan(counts, size):
                assert n > 0 and sum(own) <= size
                for x in own:
                    used[x] = used.get(x, 0) + n
            assert used == counts
    # pairs, triples and quadruples that fill sequences exactly
    assert sum(n for _, n in packing.plan({60: 3, 40: 3}, 100)) == 3
    assert sum(n for _, n in packing.plan({50: 2, 30: 2, 20: 2}, 100)) == 2
    assert sum(n for _, n in packing.plan({55: 4, 20: 4, 15: 4, 10: 4}, 100)) == 4


def test_packing_edge_rows(spark, odd):
    got = packing.best_fit_pack(odd.where("doc_id > 0"), P.path("byte_bpe_50k.json")).toPandas()
    check_packing(got, {i: ids_of(t) for i, t in enumerate(ODD)})
    twice = packing.best_fit_pack(odd.unionByName(odd), P.path("byte_bpe_50k.json")).toPandas()
    for _, own in twice.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= packing.SEQ_LEN
    assert packing.best_fit_pack(odd.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_grouping_batches_keeps_rows():
    texts = ["x" * n for n in (5, 0, 300, 7, 7, 90, 1)] + [None]
    batch = pa.RecordBatch.from_pydict({"id": list(range(8)), "text": texts})
    for target in (1, 10, 100, 1000):
        got = [r for b in grouped([batch.slice(0, 3), batch.slice(3)], "text", target) for r in b.to_pylist()]
        assert got == batch.to_pylist()


def test_a_text_without_boundaries_is_counted_in_linear_time():
    model, inner = token_count._model(Q.tokenizer("piece_bpe_32k.model"))
    times = []
    for n in (100_000, 400_000):
        text, began = "=" * n, time.time()
        assert token_count.count_tokens(text, model, inner) == len(model.encode(text))
        times.append(time.time() - began)
    assert times[1] < 12 * times[0] + 2
    mixed = "=" * 90_000 + " word é" * 3000 + "=" * 50_000
    assert token_count.count_tokens(mixed, model, inner) == len(model.encode(mixed))


def test_language_samples_rows_and_not_ids(spark):
    """One id on many rows, and a text of 4 MB: the reference stays bounded and every row counts for itself."""
    prepare(spark)
    rows = [(1, f"the house {i} and the river " * 20, "en") for i in range(300)] + [(1, f"das haus {i} und der fluss " * 20, "de") for i in range(300)]
    rows += [(2, "the " * 1_000_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = dict(lang_id.fit(df))
    assert set(refs) == {"de", "en"} and all(0 < len(r) <= lang_id.REF_BYTES + lang_id.ROWS_PER_LANG for r in refs.values())
    got = lang_id.predict(df.where("doc_id = 1"), tuple(sorted(refs.items())), ["lang"]).collect()
    assert all(r.lang == r.lang_pred for r in got)
