"""Operators of the corpus on whole small tables, against brute force."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, linededup, mixing, neardup, neighbours, packing, pseudonyms, quality, queries, toxicity, urls

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (None, "text of no id"), (4, "one two"), (4, "one two"), (5, "x" * 70_000 + " " + "long line " * 9000), (6, "a\n\nb\r\n" * 3),
    (7, "ß É日本 \u00a0 x"), (None, None), (8, "same words in this text are here " * 12), (9, "Same words in this text are here " * 12),
]


def read(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.fixture(scope="module")
def documents(spark):
    return [r.asDict() for r in read(spark, "documents").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like helpers."""
    rows = [(i, t, None, "s" if k % 3 else None, None, "c0", 1) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string, mix int")


def empty(odd):
    return odd.limit(0)


# line dedup


def brute_lines(rows, min_docs=3, min_chars=20):
    key = lambda line: re.sub("[A-Z]+", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    low = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(low(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and max(holders[key(x)]) != low(i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark, documents, odd):
    extra = [(20 + k, "A shared line of good length\nown %d\n  a SHARED line of good length\t" % k) for k in range(3)]
    rows = ODD + extra
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _mark string")
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in linededup.dedup_lines(df).collect()]
    assert sorted(got, key=str) == brute_lines(rows)
    assert linededup.dedup_lines(df).columns == ["doc_id", "text", "_mark", "n_lines", "n_dropped"]
    rows = [(d["doc_id"], d["text"]) for d in documents]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in linededup.dedup_lines(read(spark, "documents")).select("doc_id", "n_lines", "n_dropped", "text").collect()]
    assert sorted(got, key=str) == brute_lines(rows)
    assert linededup.line_dedup(empty(odd)).count() == 0


# chat


def test_chat(spark):
    import json

    call = lambda *calls: json.dumps({"content": "let me", "tool_calls": list(calls)})
    rows = [
        (1, 0, "user", 'say "x"'),
        (1, 1, "assistant", call({"id": "b", "name": "add", "arguments": {"y": 2, "x": 1}, "after": ["a"]}, {"id": "a", "name": "get", "arguments": '{"q":"z","o":{"b":1,"a":[true]}}'})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": '{"z":1,"a":2}'})), (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": "3"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": "x"})), (2, 0, None, None), (None, None, "user", ""),
        (2, 1, "assistant", call({"id": "c", "name": "add", "arguments": {"x": "1"}, "after": ["d"]}, {"id": "d", "name": "none", "arguments": "bad", "after": ["c"]})),
        (3, 1, "assistant", call({"id": "e", "name": "add", "arguments": {"x": 1, "w": 2}}, {"id": "f", "name": "add", "arguments": {"y": 2}}, {"id": "g", "name": "add", "arguments": {"x": 3, "y": 1.5}})),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, level int")
    schemas = spark.createDataFrame([("add", "x", "integer", True), ("add", "y", "number", False), ("get", "q", "string", True), ("get", "o", "object", False)], "tool string, parameter string, type string, required boolean")
    got = chat.linked(df, schemas)
    assert got.columns == chat.EVENT
    rows = [tuple(r) for r in got.orderBy("conv_id", "turn", F.asc_nulls_last("level"), "step").collect()]
    one = [r for r in rows if r[0] == 1]
    assert [(r[4], r[5], r[6], r[7]) for r in one] == [
        ("message", None, "message", None), ("message", None, "message", None), ("call", "a", "linked", True), ("result", "a", "linked", None),
        ("call", "b", "linked", True), ("result", "b", "linked", None), ("result", "zz", "no_call", None),
    ]
    assert json.loads(one[2][8])["arguments"] == '{"o":{"a":[true],"b":1},"q":"z"}' and json.loads(one[3][8])["content"] == '{"a":2,"z":1}'
    assert [(r[5], r[2], r[6], r[7]) for r in rows if r[0] == 2 and r[4] == "call"] == [("c", None, "no_result", False), ("d", None, "no_result", False)]
    assert [(r[5], r[7]) for r in rows if r[0] == 3 and r[4] == "call"] == [("e", False), ("f", False), ("g", True)]
    assert sum(r[0] is None for r in rows) == 1
    assert chat.linked(df.limit(0), schemas).count() == 0


def test_chat_checks_calls_by_declared_tools(spark):
    import json

    call = lambda i, name, arguments: {"id": i, "type": "function", "function": {"name": name, "arguments": json.dumps(arguments)}}
    add = {"name": "add", "parameters": {"type": "object", "properties": {"x": {"type": "integer"}, "y": {"type": "number"}}, "required": ["x"]}}
    tools = json.dumps({"tools": [{"type": "function", "function": add}, {"name": "now"}]})
    asked = lambda: json.dumps({"tool_calls": [call("a", "add", {"x": 1}), call("b", "add", {"y": 1}), call("c", "add", {"x": "1"}), call("d", "now", {}), call("e", "now", {"x": 1}), call("f", "other", {})]})
    other = json.dumps({"tools": [{"name": "add", "parameters": {"properties": {"x": {"type": "string"}}}}, {"name": "add", "parameters": {"properties": {"x": {"type": "integer"}}}}]})
    rows = [(1, 0, "system", tools), (1, 1, "assistant", asked()), (2, 0, "user", tools), (2, 1, "assistant", asked()), (None, 0, "system", other), (None, 1, "assistant", asked()), (3, 0, "system", "{"), (3, 1, "assistant", asked())]
    got = chat.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).filter("kind = 'call'").collect()
    valid = lambda conv: {r.call_id: r.valid for r in got if r.conv_id == conv}
    assert valid(1) == {"a": True, "b": False, "c": False, "d": True, "e": False, "f": False}
    assert valid(2) == valid(3) == dict.fromkeys("abcdef")
    assert valid(None) == {"a": True, "b": False, "c": True, "d": False, "e": False, "f": False}
    assert {json.loads(r.json)["name"] for r in got} == {"add", "now", "other"}


# mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total = sum(sizes.values())
    fixed = {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s: most * sizes[s] for s in rest if share[s] > most * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


def test_mixing(spark, documents, odd):
    docs = read(spark, "documents")
    got = mixing.mixing(docs).collect()
    size = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in documents}
    of = {d["doc_id"]: d["source"] for d in documents}
    sizes = collections.Counter()
    for i, n in size.items():
        sizes[of[i]] += n
    target = brute_targets(sizes)
    assert len(got) == len(documents)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        s = of[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], sizes[s]) and math.isclose(r.target, target[s])
        assert r.taken % max(r["size"], 1) == 0 and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] + 0.05 * target[s]
    again = mixing.mixing(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    strange = mixing.mixing(odd)
    assert strange.count() == len(ODD) and strange.filter("taken > 3 * size").count() == 0
    assert mixing.mixing(empty(odd)).count() == 0
    rows = mixing.mixed_documents(odd)
    assert rows.columns == odd.columns
    want = collections.Counter()
    for r in mixing.with_copies(odd).collect():
        want[r.doc_id, r.text] += r.mix.copies
    have = collections.Counter((r.doc_id, r.text) for r in rows.collect())
    assert have == +want


def test_targets_by_hand(spark):
    cases = [{"a": 10, "b": 10, "c": 1000}, {"a": 1, "b": 2, "c": 3, "d": 4000, None: 5}, {"a": 0, "b": 7}, {"x": 9}]
    for sizes in cases:
        rows = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes.items()], "none boolean, source string, source_size long")
        got = {None if r.none else r.source: r.target for r in mixing.targets(rows).collect()}
        want = brute_targets(sizes)
        assert all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in sizes)


# packing


def test_packing(spark, documents, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    for rows, df in (([(d["doc_id"], d["text"]) for d in documents], read(spark, "documents")), (ODD, odd)):
        ids = collections.defaultdict(list)
        for i, t in rows:
            ids[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
        pieces = packing.packing(df).collect()
        by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
        for p in pieces:
            by_doc[p.doc_id].append(p)
            by_sequence[p.sequence_id].append(p)
        for i, own in ids.items():
            if len(own) == 1:
                at = 0
                for p in sorted(by_doc[i], key=lambda p: p.start):
                    assert p.start == at and p.doc_tokens == len(own[0]) and p.length > 0
                    assert p.ids_crc32 == zlib.crc32(own[0][at : at + p.length].tobytes())
                    at += p.length
                assert at == len(own[0])
            assert sum(p.length for p in by_doc[i]) == sum(map(len, own))
        for own in by_sequence.values():
            at = 0
            for p in sorted(own, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= 2048 and at & (at - 1) == 0 and at == own[0].sequence_length
    assert packing.packing(empty(odd)).count() == 0


def test_tokens_by_piece():
    import public_tokenizers

    encode = packing.WordTokenizer(public_tokenizers.path(packing.TOKENIZER), cached=5)
    texts = ["", "don't. we'll 'x'", "ÉCOLE— naïve’s. éa. K", "<|endoftext|> A<|StartOfText|> b", "日本語。テスト, x×. ÷,", "12.5% 3,000.", "İstanbul ΣΑΣ. ΣΑΣ", "a\x85b\x1cc...", "x́. (a) [b]. it's.' 's. 're"]
    for t in [*texts, " ".join(texts[:3])]:
        raw = np.frombuffer(t.encode(), np.uint8)
        assert encode(raw, np.array([0, len(raw)]))[0].tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids


# pseudonyms


def test_pseudonyms(spark, documents, odd):
    old = (
        "call +1 (017) 555-7713 or +10175557713 or 017-555-7713, und.34@mail7.example.com; card 4539 1488 0343 6467 4539148803436467 bad 4539148803436468 "
        "ip 233.254.104.120 v 1.2.3.4.5 999.1.1.1 born 1984-02-29 29.02.1984, 12 March 2020. Licence 2.0. 1999-02-30 "
        'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" GB82WEST12345698765432 ssn 123-45-6789'
    )
    new, spans = pseudonyms.Pseudonyms("k").replace(old)
    assert pseudonyms.Pseudonyms("k", inverse=True).replace(new)[0] == old
    assert pseudonyms.Pseudonyms("other").replace(old)[0] != new
    assert [k for k, _, _ in spans] == ["phone"] * 3 + ["email", "card", "card", "ip", "date", "date", "date", "secret", "iban", "ssn"]
    for kept in ("4539148803436468", "1.2.3.4.5", "999.1.1.1", "Licence 2.0.", "1999-02-30", "@mail7.example.com"):
        assert kept in new
    digits = re.findall(r"\d{4} ?\d{4} ?\d{4} ?\d{4}", new)
    plain = [d.replace(" ", "") for d in digits]
    assert plain[0] == plain[1] and pseudonyms.luhn_digit(plain[0][:-1]) == plain[0][-1]
    assert pseudonyms.mod97(re.search(r"GB\d\d[A-Z]{4}\d{14}", new).group()) == 1
    move = pseudonyms.Permutation("k", "t", 1000)
    assert sorted(move.forward(x) for x in range(1000)) == list(range(1000))
    work = pseudonyms.Pseudonyms(pseudonyms.KEY)
    got = {r.doc_id: r for r in pseudonyms.pseudonyms(read(spark, "documents")).collect()}
    for d in documents:
        text, spans = work.replace(d["text"])
        assert (got[d["doc_id"]].text, got[d["doc_id"]].n_values) == (text, len(spans))
        for s in re.findall(r"[\w.]+@mail\d\.example\.com", d["text"]):
            assert s not in text
        if not re.search(r"[\d@=]", d["text"]):
            assert text == d["text"]
    done = pseudonyms.pseudonymised(odd)
    assert done.columns == [*odd.columns, "pii_spans"] and done.count() == len(ODD)
    assert {r.text for r in done.filter("doc_id = 1").collect()} == {None}
    assert pseudonyms.pseudonyms(empty(odd)).count() == 0


def test_pseudonyms_of_every_form():
    """A secret after a colon needs no digit near it; upper-case words after an account number are not part of it."""
    work, back = pseudonyms.Pseudonyms("k"), pseudonyms.Pseudonyms("k", inverse=True)
    new = [work.replace(t)[0].split()[-1] for t in ("password: correcthorsebattery", "7 password: correcthorsebattery")]
    assert new[0] == new[1] != "correcthorsebattery"
    for number, rest in (("ES91 2100 0418 4502 0005 1332", " BIC X"), ("BE68 5390 0754 7034", " EUR"), ("BE68539007547034", " EUR and"), ("GB82 WEST 1234 5698 7654 32", " OR")):
        text, spans = work.replace(number + rest)
        assert spans == [("iban", 0, len(number))] and text.endswith(rest) and text[:4] != number[:4]
        assert pseudonyms.mod97(text[: len(number)].replace(" ", "")) == 1 and back.replace(text)[0] == number + rest
    assert [k for k, _, _ in work.replace("AB12 4539 1488 0343 6467")[1]] == ["card"]


# near-duplicates


def multiset(text):
    words = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
    words = WORD.findall(words)
    if not words:
        return collections.Counter()
    return collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else collections.Counter([tuple(words)])


def brute_classes(rows, similarity=0.8):
    sets = [multiset(t) for _, t in rows]
    sums = [sum(s.values()) for s in sets]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    pairs = {(a, b) for own in where.values() for k, a in enumerate(own) for b in own[k + 1 :]}
    for a, b in pairs:
        over = sum((sets[a] & sets[b]).values())
        if over * (1 + similarity) >= similarity * (sums[a] + sums[b]) - 1e-9:
            parent[root(a)] = root(b)
    out = collections.defaultdict(list)
    for i in range(len(rows)):
        out[root(i)].append(i)
    return out.values()


def test_no_row_beyond_the_rate_rounded_up(spark):
    """Places in the millions and offsets next to one: sums in floating point took a row four times at a rate of three."""
    from fractions import Fraction

    rates, offsets = (3.0, 2.9999999, 0.37, 1.0, 0.0, 2.5), (0, 1, 2**29, 2**30 - 1)
    rows = [(n, rate, offset) for rate in rates for offset in offsets for n in (1, 2, 2_796_203, 2_796_204, 10**9, 2**33 + 5)]
    df = spark.createDataFrame(rows, "n long, rate double, offset long").withColumn("copies", mixing.copies_at(F.col("n"), F.col("rate"), F.col("offset")))
    for r in df.collect():
        part = Fraction(math.floor((r.rate % 1) * 2**30), 2**30)
        upto = lambda k, part=part, r=r: math.floor(part * k + Fraction(r.offset, 2**30))
        assert r.copies == math.floor(r.rate) + upto(r.n) - upto(r.n - 1) <= math.ceil(r.rate)


def test_near_copies_of_rows_repeated_in_full(spark):
    text = [f"w{k}" for k in range(80)]
    near = [*text[:79], "end"]
    rows = [(1, " ".join(text))] * 300 + [(None, " ".join(near))] * 300 + [(2, "other words of their own are here")] * 3
    got = collections.Counter((r.doc_id, r.class_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(1, 1): 300, (None, 1): 300, (2, 2): 3}
    assert neardup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 2


def test_only_rests_are_held(spark):
    """Long documents with a rest of one token each: the ids of their whole windows are not kept."""
    rows = [(k, "cat " * 4096 * (1 + k % 3)) for k in range(40)] + [(100, "cat " * 4095)]
    pieces = packing.packing(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    of = collections.defaultdict(list)
    for r in pieces:
        of[r.doc_id].append(r)
    for k, text in rows:
        n = len(text.split()) + 1
        own = sorted(of[k], key=lambda r: r.start)
        assert {r.doc_tokens for r in own} == {n} and [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]])) and sum(r.length for r in own) == n
    single = {r.ids_crc32 for r in pieces if r.length == 1}
    assert single == {zlib.crc32(np.array([1], "<u4"))}


def test_near_duplicates(spark, documents, odd):
    for rows, df in (([(d["doc_id"], d["text"]) for d in documents], read(spark, "documents")), (ODD, odd)):
        want = collections.Counter()
        for own in brute_classes(rows):
            ids = [rows[i][0] for i in own]
            least = min((i for i in ids if i is not None), default=None)
            want.update((i, least) for i in ids)
        got = collections.Counter((r.doc_id, r.class_id) for r in neardup.near_duplicates(df).collect())
        assert got == want
    kept = neardup.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(map(str, [x for k, x in enumerate(ODD) if k not in (5, 11)]))
    assert neardup.near_duplicates(empty(odd)).count() == 0 and neardup.without_near_duplicates(empty(odd)).count() == 0


def test_chain_of_near_copies(spark):
    """A group whose ends are far apart, in one class with a third of all rows."""
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([f"n{j}" for j in range(k)] + words[k:])) for k in range(40)]
    rows += [(100 + k, " ".join(f"u{k}x{j}" for j in range(60))) for k in range(80)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == 0 for k in range(40)) and all(got[100 + k] == 100 + k for k in range(80))


def test_signature_is_unbiased():
    rng = np.random.default_rng(1)
    z = []
    for _ in range(30):
        a = rng.integers(0, 60, 200)
        b = np.concatenate([a[: rng.integers(20, 200)], rng.integers(0, 60, rng.integers(1, 150))])
        s, t, n = neardup.counted(neardup.B.mix(np.concatenate([a, b]).astype(np.uint64)), np.repeat([0, 1], [len(a), len(b)]))
        m = 2000
        signature = neardup.bag_minhash(s, t, n, 2, m)
        x, y = collections.Counter(a.tolist()), collections.Counter(b.tolist())
        j = sum((x & y).values()) / sum((x | y).values())
        z.append(((signature[0] == signature[1]).mean() - j) / math.sqrt(j * (1 - j) / m))
    assert abs(np.mean(z)) < 0.6 and 0.6 < np.std(z) < 1.5


# urls


def test_urls(spark):
    rows = [
        (1, "http://a.org/x", '<link rel="canonical" href="http://b.net/es/q">'), (2, "https://b.net/es/q#z", None), (3, "http://c.org/y?u=1", "<META http-equiv=refresh content=\"0; url=http://a.org/x\">"),
        (4, "http://www.example.com/en/a", "<link href=/en/b rel=canonical>"), (5, "http://www.example.com/en/b", ""), (6, None, "x"), (7, "nourl", None),
        (8, "http://d.org/", '<link rel="canonical" href="//c.org/y?u=1">'), (9, "http://e.org/p/q", '<link rel="canonical" href="r">'), (10, "http://e.org/p/r", ""),
        (11, "http://EXAMPLE.com/en/", ""), (None, "x://b.net/es/q", None), (12, "http://f.org/", '<link rel=canonical href="http://g.com/"><link rel=canonical href="http://b.net/es/q2">'), (12, "http://f.org/", None),
        (13, "http://xnet/es/", ""), (14, "http://h.net", None),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = {(r.page_id, r.url): (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, urls.rule_table(spark, urls.RULES)).collect()}
    verdict = {k[0]: v[3] for k, v in got.items()}
    assert [verdict[k] for k in range(1, 15)] == ["block", "block", "block", "allow", "allow", "allow", "allow", "block", "allow", "allow", "block", "allow", "allow", "allow"]
    assert got[11, "http://EXAMPLE.com/en/"] == ("example.com", "/en/", "example.com/en/", "block") and got[14, "http://h.net"] == ("h.net", "", None, "allow")
    assert got[6, None] == ("", "", None, "allow") and got[4, "http://www.example.com/en/a"][2] == "www.example.com/en/"
    assert urls.url_filter(df).count() == len(rows) and urls.url_filter(df.limit(0)).count() == 0
    moved = spark.createDataFrame([("http://h.net", "http://z.net/fr/")], "source string, target string")
    again = urls.filter_urls(df, urls.rule_table(spark, urls.RULES), moved)
    assert again.filter("page_id = 14").first().verdict == "block"


# neighbours


def brute_neighbours(rows, asked, k=20):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if asked(q):
            scored = [(-sum((x * y for x, y in zip(a, b)), 0.0), i) for i, b in good if i != q]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_neighbours(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in read(spark, "embeddings").collect()]
    want = brute_neighbours(rows, lambda i: i % 20 == 0)
    found = collections.defaultdict(list)
    for r in neighbours.nearest(read(spark, "embeddings"), F.col("vec_id") % 20 == 0, shard_rows=100, leaf=8).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(math.isclose(a[1], b[1], rel_tol=1e-12) for q in want for a, b in zip(found[q], want[q]))
    loose = neighbours.nearest(read(spark, "embeddings"), F.col("vec_id") % 20 == 0, shard_rows=500, leaf=8, factor=0.05).collect()
    recall = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in loose) / sum(map(len, want.values()))
    assert 0.3 < recall <= 1


def test_neighbours_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.0] * 3), (2, None), (3, [nan, 1.0, 1.0]), (4, [inf, 0.0, 1.0]), (5, [1.0, None, 2.0]), (None, [1.0, 1.0, 1.0]), (6, [])]
    rows += [(10 + k, [2.0, 1.0, 0.5]) for k in range(30)] + [(50, [9.0, -3.0, 1.0]), (60, [0.5, 0.5, 100.0])]
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<float>, shard int, kind string")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, leaf=4, shard_rows=9).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == brute_neighbours(rows, lambda i: i % 20 == 0)
    few = df.filter("vec_id in (0, 50)")
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.neighbours(few).collect()] == [(0, 1, 50)]
    assert neighbours.neighbours(df.limit(0)).count() == 0


# toxicity


def test_toxicity(spark, odd):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    strange = toxicity.toxicity(docs.unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars")), labels.withColumn("text", F.lit("x")))
    assert strange.count() == docs.count() + len(ODD) and strange.filter("score is null or isnan(score)").count() == 0
    kept = toxicity.without_toxic(odd, labels)
    assert kept.columns == odd.columns
    assert toxicity.toxicity(empty(odd), labels).count() == 0
    nothing = labels.limit(0)
    assert {r.predicted for r in toxicity.toxicity(odd, nothing).collect()} == {0}


def test_toxicity_held_out(spark):
    """Accuracy on English labelled rows that were not learnt from."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = toxicity.toxicity(docs, labels).filter("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.filter("lang = 'en'").select("predicted", "toxic").collect()
    toxic = [r for r in rows if r.toxic]
    assert len(toxic) > 40
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97 and sum(r.predicted for r in toxic) / len(toxic) > 0.8
    assert sum(r.predicted for r in rows if not r.toxic) / len(rows) < 0.01


def test_toxicity_of_all_languages(spark):
    """Held-out recall by language: a stem that begins a word is longer than four bytes."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).filter("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    for lang, least in (("en", 0.85), ("de", 0.85), ("fr", 0.85), ("es", 0.6)):
        toxic = [r for r in rows if r.lang == lang and r.toxic]
        assert sum(r.predicted for r in toxic) >= least * len(toxic) > 0
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)


def brute_kneser_ney(words, discount, shared_discount):
    """Log ratio of every sequence of (letters of a word with its end, plain times, toxic times), counted with dictionaries."""
    n = [collections.Counter(), collections.Counter()]
    for word, *times in words:
        spelled = [32] * 7 + list(word) + [32]
        for k in range(7, len(spelled)):
            for side in (0, 1):
                n[side][tuple(spelled[k - 7 : k + 1])] += times[side]
    grams = {g for side in n for g in side}
    before = {k: collections.Counter(x[1:] for x in {g[-k - 1 :] for g in grams}) for k in range(1, 8)}
    total = {k: collections.Counter() for k in before}
    kinds = {k: collections.Counter() for k in before}
    for k, counts in before.items():
        for u, c in counts.items():
            total[k][u[:-1]] += c
            kinds[k][u[:-1]] += 1

    def shared(u):
        if not u:
            return 1 / 256
        k, h = len(u), u[:-1]
        return (max(before[k][u] - shared_discount, 0) + shared_discount * kinds[k][h] * shared(u[1:])) / total[k][h]

    def own(side, g):
        inside = {x: c for x, c in n[side].items() if x[:-1] == g[:-1]}
        if not sum(inside.values()):
            return shared(g[1:])
        freed = sum(min(c, discount) for c in inside.values())
        return (max(n[side][g] - discount, 0) + freed * shared(g[1:])) / sum(inside.values())

    return {g: math.log(own(1, g) / own(0, g)) for g in grams}


def test_kneser_ney_by_hand(spark):
    """The distributed models against dictionaries, on the words of labelled texts and some made-up ones."""
    import random

    rng = random.Random(3)
    words = collections.Counter()
    docs = [r.text for r in read(spark, "documents").limit(12).collect()]
    for k, text in enumerate(docs):
        for w in re.findall("[a-z]+", (text or "").lower())[:150]:
            words[w, k % 4 == 0] += 1
    for w in ("scum", "scums", "scumbag", "plainly", "plain", "abcdefghijkl"):
        words[w, w.startswith("scum")] += rng.randint(2, 40)
    rows = [(w.encode(), words[w, False], words[w, True]) for w in sorted({w for w, _ in words})]
    grams = collections.defaultdict(lambda: [0, 0])
    for w, plain, toxic in rows:
        for g in toxicity.steps(pa.array([w]))[0].tolist():
            grams[g][0] += plain
            grams[g][1] += toxic
    df = spark.createDataFrame([(g, *c) for g, c in grams.items()], "g long, plain long, toxic long")
    got = {tuple(int(r.g).to_bytes(8, "big", signed=True)): r.ratio for r in toxicity.log_ratios(df).collect()}
    want = brute_kneser_ney(rows, toxicity.DISCOUNT, toxicity.SHARED_DISCOUNT)
    assert set(got) == {g for g, r in want.items() if abs(r) > toxicity.DUST}
    assert all(r == pytest.approx(want[g], abs=1e-9) for g, r in got.items())


def test_toxicity_model_shuffles_its_sequences_few_times(spark):
    """The higher orders of the backoff share one deal: an exchange each for every order made check_h run out of disk."""
    plan = toxicity.log_ratios(spark.range(10).selectExpr("id AS g", "id AS plain", "id AS toxic"))._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange") <= 20


def test_toxicity_of_unseen_sequences(spark):
    """Exact keys: words that no label speaks of say nothing, whatever else the model holds."""
    model = spark.createDataFrame([(int(g), 9.0) for g in toxicity.steps(pa.array([b"scum"]))[0]], "g long, ratio double")
    docs = spark.createDataFrame([(" ".join(f"{k:x}g" for k in range(20_000)),), ("Scum!",), (None,)], "text string")
    assert [(bytes(r.word), r.ratio) for r in toxicity.marked_words(docs, model).collect()] == [(b"scum", 45.0)]


def test_toxicity_scores_every_word(spark, monkeypatch):
    """A text's value is the mean over all its words of both likelihoods, sequences that no label has included, against loops."""
    docs = spark.createDataFrame([(1, "The scum and the scams, the scum"), (2, "the scope of it"), (3, ""), (4, None), (5, "zzz " * 9)], "key long, text string")
    grams = collections.defaultdict(lambda: [0, 0])
    for word, plain, toxic in ((b"the", 60, 20), (b"scum", 1, 30), (b"scope", 9, 1), (b"and", 50, 11), (b"it", 20, 5)):
        for g in toxicity.steps(pa.array([word]))[0].tolist():
            grams[g][0] += plain
            grams[g][1] += toxic
    ratios = {r.g: r.ratio for r in toxicity.log_ratios(spark.createDataFrame([(g, *c) for g, c in grams.items()], "g long, plain long, toxic long")).collect()}

    def backed(context, side):
        counts = [c[side] for g, c in grams.items() if g >> 8 == context]
        return sum(min(c, toxicity.DISCOUNT) for c in counts) / sum(counts) if sum(counts) else 1.0

    def value(word):
        codes = toxicity.steps(pa.array([word.encode()]))[0].tolist()
        r = sum(ratios[g] if g in ratios else math.log(backed(g >> 8, 1) / backed(g >> 8, 0)) for g in codes)
        return math.log(1 - toxicity.SHARE + toxicity.SHARE * math.exp(r))

    assert all(abs(value(w)) > 0 for w in ("the", "scum", "scams", "and", "scope", "it"))  # none is too weak to count
    want = {}
    for r in docs.collect():
        found = re.findall("[a-z]+", (r.text or "").lower())
        want[r.key] = toxicity.UNIT * sum(map(value, found)) / (sum(len(w) + 1 for w in found) + toxicity.PRIOR_LENGTH)
    counted = spark.createDataFrame([(g, *c) for g, c in grams.items()], "g long, plain long, toxic long")
    model = toxicity.log_ratios(counted, summands=True)
    for held, most in ((1 << 19, 1 << 18), (5, 2), (1, 0)):  # the same result wherever a word or sequence is looked up
        monkeypatch.setattr(toxicity, "BEGINNINGS", held)
        monkeypatch.setattr(toxicity, "COMMON", most)
        got = {r.key: r.raw for r in toxicity.with_raw(docs, model).collect()}
        assert got == pytest.approx(want, abs=1e-9)


def test_sequences():
    code, of = toxicity.sequences(np.frombuffer(b"ab, 1d", np.uint8), np.array([0, 4, 4, 6]))
    assert of.tolist() == [0, 3, 3, 5]
    assert [int(c).to_bytes(4, "big").decode() for c in code] == ["   a", "  ab", " ab ", "   1", "  1d"]


# quality


def brute_quality(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark, documents, odd):
    for rows, df in (([(d["doc_id"], d["text"]) for d in documents], read(spark, "documents")), (ODD, odd)):
        want = collections.Counter((i, *brute_quality(t)) for i, t in rows)
        out = quality.compression_bands(df).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
        assert not any(r.kept and r.base_failed for r in out)
    assert quality.compression_bands(empty(odd)).count() == 0


def test_compression_bands(spark):
    import base64
    import random

    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    prose = " ".join(rng.choice(vocabulary) for _ in range(1500))
    noise = " ".join(base64.b64encode(rng.randbytes(60)).decode() for _ in range(200))
    passage = " ".join(rng.choice(vocabulary) for _ in range(700))
    hidden = passage + " " + " ".join(f"ab{rng.choice('xy')}" for _ in range(1100)) + " " + prose
    rows = [(1, prose), (2, noise), (3, hidden)]
    got = {r.doc_id: r for r in quality.compression_bands(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and not got[2].kept and not got[3].kept


def plain_ratios(text, chunk=quality.CHUNK):
    """(whole, least, most) with one compressor call per piece."""
    import zstandard

    press = zstandard.ZstdCompressor(level=quality.LEVEL, write_checksum=False, write_content_size=False)
    ratio = lambda b: len(b) / len(press.compress(b))
    data = (text or "").encode()
    if not data:
        return 1.0, 1.0, 1.0
    pieces = [data[k : k + chunk] for k in range(0, len(data), chunk)]
    if len(pieces) > 1 and len(pieces[-1]) < quality.LEAST_REST:
        pieces[-2:] = [pieces[-2] + pieces[-1]]
    found = [ratio(p) for p in pieces] if len(pieces) > 1 else [ratio(data)]
    return ratio(data), min(found), max(found)


def test_bands_equal_a_plain_loop_and_decide(spark):
    """`kept` by hand from the same limits; on held-out labels the bands reject poor texts and hardly any good one."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.compression_bands(docs.join(labels, "doc_id", "left_semi"))
    limits = quality.fit_limits(scored, labels)
    assert len(limits) >= 10
    text = {r.doc_id: r.text for r in docs.join(labels, "doc_id", "left_semi").collect()}
    good = {r.doc_id: r.quality == 1 for r in labels.collect()}
    found = [r for r in quality.with_limits(scored, limits).collect() if not r.base_failed]
    for r in found[::3]:
        whole, low, high = plain_ratios(text[r.doc_id])
        assert (r.ratio, r.chunk_min, r.chunk_max) == pytest.approx((whole, low, high))
        four = limits.get(math.floor(2 * math.log2(len(text[r.doc_id].encode()))))
        assert four is None or r.kept == (four[0] <= whole <= four[1] and four[2] <= low and high <= four[3])
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    caught, wrong = (sum(not r.kept for r in held if good[r.doc_id] == side) for side in (False, True))
    poor = sum(not good[r.doc_id] for r in held)
    assert caught >= 0.95 * (caught + wrong) and caught >= 0.55 * poor > 20


def test_bands_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same = lambda df: collections.Counter(map(tuple, df.collect()))
    assert quality.fit_limits(quality.compression_bands(odd), none) == {} and same(quality.quality_bands(odd, none)) == same(quality.compression_bands(odd))
    some = spark.createDataFrame([(8, 1, 0), (8, None, 0), (None, 1, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    assert quality.quality_bands(odd, some).count() == len(ODD) and quality.quality_bands(empty(odd), some).count() == 0


# queries and the pipeline


def test_compression_of_the_rest():
    """Junk after the first 4096 bytes of a text under 8192 is a chunk of its own."""
    import base64
    import random

    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(150)]
    prose = " ".join(rng.choice(vocabulary) for _ in range(2000))
    junk = base64.b64encode(rng.randbytes(3000)).decode()
    texts = [(prose[:4100] + junk[:3900]).encode(), prose[:8000].encode(), (prose[:4096] + junk[:300]).encode(), prose[:300].encode(), b""]
    offsets = np.cumsum([0, *map(len, texts)])
    ratio = quality.ratios(np.frombuffer(b"".join(texts), np.uint8), offsets, quality.CHUNK, quality.LEVEL)
    assert ratio[0, 0] >= 1.45 and ratio[0, 1] >= 1.35 > ratio[0, 3]
    assert np.isnan(ratio[2:, 3]).all()
    assert quality.within(np.diff(offsets), ratio, quality.BANDS).tolist()[:3] == [False, True, True]


def test_queries_are_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in names
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = read(spark, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.stored(spark, stage(spark, docs, DATA))
        assert docs.columns == columns
        seen[name] = (before, {r.doc_id: r.text for r in docs.collect()})
    before, after = seen["line dedup"]
    assert set(before) == set(after)
    assert {(i, n) for i, _, _, n in brute_lines(list(before.items()))} == set(after.items())
    before, after = seen["near duplicates"]
    rows = list(before.items())
    assert set(after) == {min(rows[i][0] for i in own) for own in brute_classes([r for r in rows]) if multiset(rows[own[0]][1])} | {i for i, t in rows if not multiset(t)}
    before, after = seen["mixing"]
    assert set(after) <= set(before)
    pieces = packing.packing(docs)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).agg(F.sum("length")).first() == pieces.agg(F.sum("length")).first()


@pytest.mark.parametrize("rows", [ODD, []])
def test_pipeline_on_odd_rows(spark, odd, tmp_path, rows):
    """The whole run on nulls, empty and long texts, repeated rows, clashing names, and on no row at all."""
    import os

    import corpus_pipeline
    from tidemark.operators.lineage import shared_folder

    folder = str(tmp_path)
    (odd if rows else empty(odd)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(8, 1, 0), (9, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    before = {x for x in os.listdir(shared_folder(spark)) if x.startswith("pipeline-")}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert len({x for x in os.listdir(shared_folder(spark)) if x.startswith("pipeline-")} - before) == 1
    assert {r.doc_id for r in pieces} <= {i for i, _ in rows} and bool(pieces) == bool(rows)
    held = collections.Counter()
    for r in pieces:
        held[r.sequence_id] += r.length
        assert 0 < r.length <= r.doc_tokens
    assert all(n <= 2048 for n in held.values())
