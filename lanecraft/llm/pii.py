"""Personal data by bootstrapped contextual extraction.

Entities of fixed forms (e-mail, IPv4, card, phone; the *base*) are seeds.  The one and the two words before a seed are
lexical patterns; looser forms (``user [at] host``, IPv6, digit groups without a plus sign or a valid check digit) after
the same words are candidate instances.  Spark scores the graph of patterns and instances in rounds:

* the confidence of a pattern for a kind is the believed share of the places where its words occur at all in the
  corpus (counted over every text), one place more being added to the count;
* a seed is believed wholly; a candidate as far as its patterns of at least ``FLOOR`` confidence make it likely,
  taken as independent (1 - product of 1 - confidence).

A pattern needs ``SEEDS`` different seeds, so copies of a text make none.  Candidates with belief and a pattern of at
least ``ACCEPT`` become spans beside the base ones, which always stay.

Defined results: a null or empty text has no spans; repeated rows are rows of their own.  Spans are in code points, the
end exclusive.  Texts are read whole; a pattern word is at most ``WORD`` bytes long and its words lie within ``BACK``
code points of the entity (longer ones are no patterns).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lanecraft.llm.common import grouped, release, sized, stage

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
SEEDS, FLOOR, ACCEPT, ROUNDS = 3, 0.5, 0.8, 4
WORD, BACK = 40, 256
#: Pattern words that a task holds at once when it counts them; more are counted in further passes.
SLICE = 200_000

# fixed forms of the base; a run of digits is entered at its first one, so long runs stay linear
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# looser forms of candidates
_MAILED = re.compile(r"\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)*+", re.I)
_COLONS = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_DIGITS = re.compile(r"(?<![0-9])[0-9](?:[\x20().\-/]{0,2}[0-9])++")
_OPENERS = "([{<\"'*_"
_SPACE = "\x20\t\n\x0b\x0c\r"
#: Pattern words are lower-cased and their digits made equal (ASCII only).
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))

_MARK = "struct<kind:int,seed:boolean,start:long,end:long,inst:binary,one:string,two:string>"
_SPAN = "struct<start:long,kind:int,end:long>"


# ── one text ─────────────────────────────────────────────────────────────────

def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _mails(text: str, domain: re.Pattern):
    """(start, end) of non-overlapping addresses: a local part before each domain, not reaching into the one before."""
    end = 0
    for m in domain.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the entities of fixed form, in order."""
    out = []
    if "@" in text:
        out += [(a, EMAIL, b) for a, b in _mails(text, _DOMAIN)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(digits(m[0])) <= 15:
                out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def candidates(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of entities of looser form that touch no known one."""
    out = []
    if "@" in text or "at)" in text or "at]" in text or "AT" in text:
        out += [(a, EMAIL, b) for a, b in _mails(text, _MAILED)]
    if ":" in text:
        out += [(m.start(), IP, m.end()) for m in _COLONS.finditer(text)]
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 7:
            n = len(digits(m[0]))
            out += [(m.start(), k, m.end()) for k, low, high in ((CARD, 12, 19), (PHONE, 7, 15)) if low <= n <= high]
    taken = sorted((a, b) for a, _, b in known)
    free, i, reach = [], 0, 0
    for a, kind, b in sorted(out):
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= a:
            free.append((a, kind, b))
    return free


def pattern_words(text: str, start: int) -> tuple[str | None, str | None]:
    """The word and the two words before a place where a word begins (opening marks aside)."""
    while start and text[start - 1] in _OPENERS:
        start -= 1
    low = max(0, start - BACK)
    before = text[low:start]
    if not before or before[-1] not in _SPACE:
        return None, None
    words = before.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if low and before[0] not in _SPACE:  # the first one may have begun earlier
        words = words[1:]
    if not words or len(words[-1]) > WORD:
        return None, None
    one = words[-1].decode("utf-8", "replace")
    return one, f"{words[-2].decode('utf-8', 'replace')} {one}" if len(words) > 1 and len(words[-2]) <= WORD else None


def instance(kind: int, text: str) -> bytes:
    """What makes two entities the same one; a digest, so that no personal data are written."""
    plain = text.lower() if kind in (EMAIL, IP) else digits(text)
    return hashlib.blake2b(f"{kind}:{plain}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def scan(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Per row: id, base (spans) and marks: seeds and candidates with their pattern words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in grouped(batches, "text"):
            spans, marks = [], []
            for t in batch.column(1).to_pylist():
                t = t or ""
                known = base(t)
                spans.append([{"start": a, "kind": k, "end": b} for a, k, b in known])
                own = []
                for seed, found in ((True, known), (False, candidates(t, known))):
                    for a, k, b in found:
                        one, two = pattern_words(t, a)
                        if one is not None:
                            own.append({"kind": k, "seed": seed, "start": a, "end": b, "inst": instance(k, t[a:b]), "one": one, "two": two})
                marks.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS), pa.array(marks, _MARKS)], ["id", "base", "marks"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, base array<{_SPAN}>, marks array<{_MARK}>")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_MARKS = pa.list_(pa.struct([("kind", pa.int32()), ("seed", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()),
                             ("inst", pa.binary()), ("one", pa.string()), ("two", pa.string())]))


# ── patterns and instances ───────────────────────────────────────────────────

def occurrences(docs: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often the words of each pattern stand before another word, over all texts.

    A task holds a slice of the patterns (at most some ``SLICE``); more slices are more passes over the texts."""
    spark = docs.sparkSession
    patterns = stage(patterns.select("pattern").distinct(), "patterns")
    slices = -(-patterns.count() // SLICE)
    out = None
    for i in range(slices):
        own = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(slices)) == i)
        words = spark.sparkContext.broadcast([r[0].encode() for r in own.collect()])

        def run(batches, words=words):
            held = set(words.value)
            last = {w.rpartition(b" ")[2] for w in held}
            total: Counter = Counter()
            for batch in grouped(batches, "text"):
                for t in batch.column(0).to_pylist():
                    seen = (t or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
                    for j, w in enumerate(seen[:-1]):
                        if w in last:
                            if w in held:
                                total[w] += 1
                            if j and (two := seen[j - 1] + b" " + w) in held:
                                total[two] += 1
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["pattern", "n"])
            release()

        part = docs.select(F.col(text).alias("text")).mapInArrow(run, "pattern string, n long")
        part = stage(part.groupBy("pattern").agg(F.sum("n").alias("total")), "occurrences")
        out = part if out is None else out.unionByName(part)
    return out


def confident(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, confidence) and (kind, inst, belief) after the rounds.

    ``edges``: pattern, kind, inst, seed, n (places)."""

    def patterns(belief: DataFrame | None) -> DataFrame:
        held = F.when(F.col("seed"), 1.0)
        rows = edges
        if belief is not None:
            rows = edges.join(belief, ["kind", "inst"], "left")
            held = held.otherwise(F.coalesce("belief", F.lit(0.0)))
        share = rows.groupBy("pattern", "kind").agg(F.sum(F.coalesce(F.col("n") * held, F.lit(0.0))).alias("n"))
        return stage(share.join(totals, "pattern").select("pattern", "kind", (F.col("n") / (F.col("total") + 1)).alias("confidence")), "confidence")

    conf, belief = patterns(None), None
    for i in range(rounds):
        strong = edges.where(~F.col("seed")).join(conf.where(F.col("confidence") >= FLOOR), ["pattern", "kind"])
        doubt = F.sum(F.log1p(-F.least("confidence", F.lit(0.999))))
        belief = stage(strong.groupBy("kind", "inst").agg((1 - F.exp(doubt)).alias("belief")), "belief")
        if i + 1 < rounds:
            conf = patterns(belief)
    return conf, belief


def learn(docs: DataFrame, text: str, marks: DataFrame, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame] | None:
    """Scores of patterns and candidates (see ``confident``), or None without any pattern that enough seeds share."""
    both = marks.select("kind", "seed", "inst", F.explode(F.array("one", "two")).alias("pattern")).where("pattern is not null")
    edges = stage(both.groupBy("pattern", "kind", "inst", "seed").agg(F.count(F.lit(1)).alias("n")), "edges")
    support = stage(edges.where("seed").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= seeds), "support")
    if support.isEmpty():
        return None
    edges = stage(edges.join(support.select("pattern", "kind"), ["pattern", "kind"]), "edges")
    return confident(edges, occurrences(docs, text, support))


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seeds: int = SEEDS, accept: float = ACCEPT) -> DataFrame:
    """Per row: id, base and found (arrays of start, kind number, end; ``found`` holds what the patterns add)."""
    seen = stage(scan(docs, id_col, text).withColumn("row", F.monotonically_increasing_id()), "scanned")
    marks = seen.select("row", F.explode("marks").alias("m")).select("row", "m.*")
    scored = learn(docs, text, marks, seeds)
    plain = seen.select(F.col("id").alias(id_col), "row", "base")
    if scored is None:
        return plain.select(id_col, "base", F.array().cast(f"array<{_SPAN}>").alias("found"))
    conf, belief = (stage(x.where(x[x.columns[2]] >= accept), "accepted") for x in scored)
    loose = marks.where("not seed").select("row", "kind", "start", "end", "inst", F.explode(F.array("one", "two")).alias("pattern"))
    good = loose.join(sized(conf, 120), ["pattern", "kind"]).join(sized(belief, 48), ["kind", "inst"])
    best = good.groupBy("row", "start").agg(F.max_by(F.struct("start", "kind", "end"), F.struct("confidence", -F.col("kind"))).alias("span"))
    found = best.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("found"))
    return plain.join(found, "row", "left").select(id_col, "base", F.coalesce("found", F.array().cast(f"array<{_SPAN}>")).alias("found"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: id_col, counts of the base by kind, the digest of the base, all spans, and how many the
    patterns added (``n_added``)."""
    got = find(docs, id_col, text, **options)
    kinds = F.col("base.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, F.lit(k)))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return got.select(F.col(id_col), *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                      listed(F.array_sort(F.concat("base", "found"))).alias("spans"), F.size("found").cast("long").alias("n_added"))
