"""Languages, personal data, tokens, web records, fingerprints, lines, repeats and mixing."""

import collections
import gzip
import hashlib
import json
import math
import random
import re
import time
import zlib
from fractions import Fraction
from itertools import islice

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vicinal.llm import bpe, language_id, line_dedup, merkle, mixing, pii, ranges, repeats, warc

# ---- language ID


class SlowPpm:
    def __init__(self, texts):
        self.counts = collections.defaultdict(collections.Counter)
        for t in texts:
            d = language_id.PAD + language_id._bytes(t)
            for i in range(4, len(d)):
                for k in range(5):
                    self.counts[d[i - k : i]][d[i]] += 1

    def bits(self, text):
        d, total = language_id.PAD + text, 0.0
        for i in range(4, len(d)):
            for k in range(4, -1, -1):
                c = self.counts.get(d[i - k : i])
                if not c:
                    continue
                n, kinds = sum(c.values()), len(c)
                if d[i] in c:
                    total -= math.log2(c[d[i]] / (n + kinds))
                    break
                total -= math.log2(kinds / (n + kinds))
            else:
                total += 8
        return total


def test_code_lengths(documents, monkeypatch):
    rows = documents.where("n_chars < 4000").orderBy("doc_id").limit(40).collect()
    samples = collections.defaultdict(list)
    for r in rows[:24]:
        samples[r.lang].append(r.text)
    model = language_id.PpmModel(samples)
    slow = [SlowPpm(samples[x]) for x in model.languages]
    texts = [language_id._bytes(t) for t in [*(r.text for r in rows[24:]), "", "a", "ÿ ŋŋ 中文 zz"]]
    want = [[s.bits(t) for s in slow] for t in texts]
    assert np.allclose(model.code_lengths(texts), want, rtol=1e-5, atol=1e-2)
    monkeypatch.setattr(language_id, "CHUNK", 500)
    monkeypatch.setattr(language_id, "GROUP", 1)
    assert np.allclose(language_id.PpmModel(samples).code_lengths(texts), want, rtol=1e-5, atol=1e-2)
    assert np.allclose([model._long(t) for t in texts if len(t) > 500], [w for t, w in zip(texts, want, strict=True) if len(t) > 500], rtol=1e-5, atol=1e-2)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95


def test_every_language_is_learned(spark):
    """A hundred labels, some with one very long text first: each is predicted for its own words."""
    r = random.Random(7)
    words = {f"l{i:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(8)] for i in range(100)}
    rows = [(i, " ".join(r.choice(words[x]) for _ in range(30)), x) for i, x in enumerate(sorted(words) * 8)]
    rows += [(10_000 + i, " ".join(r.choice(words[x]) for _ in range(90_000)), x) for i, x in enumerate(["l000", "l099"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.PpmModel({x: [" ".join(w)] for x, w in words.items()}).code_lengths([b"abc", b""]).shape == (2, 100)
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert sum(got[i].lang_pred == x for i, _, x in rows) >= 0.97 * len(rows)
    sample = language_id.training_sample(df, "doc_id", "text", "lang", text_bytes=20_000)
    assert len(sample) == 100 and all(sum(map(len, t)) <= 20_000 and len(t) > 2 for t in sample.values())
    assert sum(len(x) for t in language_id.training_sample(df, "doc_id", "text", "lang", all_bytes=50_000).values() for x in t) <= 50_000


def test_language_of_odd_rows(odd):
    rows = language_id.identify(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    und = [r.doc_id for r in rows if r.lang_pred == "und"]
    assert sorted(x for x in und if x is not None) == [7, 8, 9, 13] and und.count(None) == 1
    assert {r.lang_pred for r in language_id.identify(odd.where("lang is null")).collect()} == {"und"}
    assert language_id.identify(odd.limit(0)).count() == 0
    kept = language_id.keep_identified(odd)
    assert kept.columns == odd.columns and kept.where("lang is null").count() == 0 and kept.count() == 8


# ---- personal data

E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP, CARD, PHONE = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_spans(x):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in E.finditer(x)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(x) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(x):
        d = digits(m.group())
        s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(x) if 9 <= len(digits(m.group())) <= 15]


def test_patterns():
    r = random.Random(3)
    for _ in range(8000):
        letters = r.choice(["a.@-1_ ", "0123456789.", "0123456789 -+()", "ab@.c1-%+\n²٣é", "+1 (2)-.345@x"])
        x = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        assert pii.base_spans(x) == slow_spans(x), x
    pii.base_spans("1" * 300000 + "a" * 300000 + "@" * 1000)  # linear


def slow_disclosure(texts, disclosure=0.8, support=3):
    """{(term, entity): (share, general)} by counting every pair of every document."""
    held = []
    for t in texts:
        t = t or ""
        spans = slow_spans(t)
        free = "".join(" " if any(s <= i < e for _, s, e in spans) else c for i, c in enumerate(t))
        # a word that a span cuts is no term
        terms = {m.group().lower() for m in re.finditer(r"[^\W\d_]{3,}", t) if free[m.start() : m.end()] == m.group()}
        held.append((terms, {pii.entity(k, t[s:e]) for k, s, e in spans}, {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)}))
    out, n = {}, len(texts)
    for entity in {e for _, es, _ in held for e in es}:
        n_e = sum(entity in es for _, es, _ in held)
        shares = {}
        for term in {t for ts, es, _ in held if entity in es for t in ts}:
            both, n_t = sum(entity in es and term in ts for ts, es, _ in held), sum(term in ws for _, _, ws in held)
            if both >= support and n > n_e:
                shares[term] = (math.log2(both * n / (n_t * n_e)) / math.log2(n / n_e), both)
        safe = [(-s, t) for t, (s, both) in shares.items() if both >= 0.8 * n_e and s < disclosure / 2]
        out |= {(t, entity): (s, min(safe)[1] if safe else None) for t, (s, _) in shares.items() if s >= disclosure}
    return out


def leak(n):
    rows = [(i, f"said Zorbax today about things {'abcdef'[i % 6]}\nwrite to zed@mail.example.org or call\n{'and so on ' * 20}zorbax!") for i in range(n)]
    return rows + [(100 + i, f"other words about things today {i} said nobody") for i in range(200)]


@pytest.mark.parametrize("limit", [1000, 0])
def test_terms_that_disclose(spark, limit):
    r = random.Random(8)
    rows = leak(5) + leak(5)[:2] + [(None, leak(1)[0][1]), (300, None)]
    common, rare = ["apple", "berry", "cherry", "delta"], [f"rare{c}x" for c in "abcdef"]
    for i in range(120):
        k = r.randrange(4)
        at = [f"p{k}@x.org", f"+1 555 000 00{k}{k}"] if r.random() < 0.4 else []
        rows.append((400 + i, " ".join([r.choice(common), *at, *([r.choice([rare[k], "RARE" + rare[k][4:]])] if at and r.random() < 0.9 else [r.choice(rare[4:])]), "b" * 600, r.choice(common)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_disclosure([t for _, t in rows])
    table = {(x.term, x.entity): (x.share, x.general) for x in pii.disclosing_terms(df, broadcast_terms=limit).collect()}
    assert set(table) == set(want) and len({e for _, e in want}) > 3
    assert all(abs(table[k][0] - s) < 1e-9 and table[k][1] == g for k, (s, g) in want.items())
    got = pii.find_pii(df, broadcast_terms=limit).collect()
    by_row = collections.Counter((x.doc_id, x.base_sha256, x.spans, x.sanitised) for x in got)
    for i, text in rows:
        text = text or ""
        base = slow_spans(text)
        mine = {pii.entity(k, text[s:e]) for k, s, e in base}
        becomes = {}
        for (t, e), (_, g) in sorted(want.items(), key=lambda kv: kv[1][1] or "~"):
            if e in mine:
                becomes.setdefault(t, g)
        marks = [(m.start(), m.end(), becomes[m.group().lower()]) for m in re.finditer(r"[^\W\d_]{3,}", text) if m.group().lower() in becomes and not any(s < m.end() and m.start() < e for _, s, e in base)]
        spans = [*base, *(("term", s, e) for s, e, _ in marks)]
        clean, at = "", 0
        for s, e, shown in sorted([*((s, e, k) for k, s, e in base), *marks]):
            if s >= at:
                clean += text[at:s] + (f"[{shown}]" if shown else "")
            at = max(at, e)
        key = (i, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e in spans), clean + text[at:])
        assert by_row[key] > 0, key
    assert sum(by_row.values()) == len(rows)
    first = next(x for x in got if x.doc_id == 0)
    assert first.n_terms >= 2 and "orbax" not in first.sanitised and first.n_spans == first.n_terms + 1
    few = pii.find_pii(spark.createDataFrame(leak(2), "doc_id long, text string")).where("doc_id < 100").collect()
    assert all("term" not in r.spans for r in few)


def test_pii_of_odd_rows(odd):
    rows = pii.find_pii(odd).collect()
    assert len(rows) == odd.count() and all(r.spans == "" for r in rows)
    assert pii.find_pii(odd.limit(0)).count() == 0
    assert pii.find_pii(odd, write=False).columns[-1] == "n_spans"


# ---- tokens


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.read_vocabulary(bpe.default_vocabulary()))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(encoder, text):
    return np.frombuffer(b"".join(encoder.packed(text)), "<u4").tolist()


def test_ids_and_text_are_the_librarys(merges, library, documents):
    encoder, r = bpe.Encoder(merges), random.Random(1)
    letters = [chr(c) for c in range(0x250)] + list("  \n\n\t'’ \x1c\x85😀中文字अआ²½٣ⅧǅÁ<|endoftext|>") * 8 + ["<|endoftext|>", "'ll", "'s", "  ", "\r\n"] * 30
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += [x.text for x in documents.select("text").collect()] + ["a" * 5000, "word " * 20000]
    for t in texts:
        ids = ids_of(encoder, t)
        assert ids == library.encode(t, add_special_tokens=False).ids
        back = bpe.ByteToText(merges)
        assert "".join(back.feed(ids[i : i + 3]) for i in range(0, len(ids), 3)) + back.finish() == library.decode(ids, skip_special_tokens=False)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_transducer_emits_what_the_whole_gives(merges):
    r = random.Random(2)
    assert 1 <= merges.lookahead < 1000
    for _ in range(60):
        data = (r.choice(["ab", "a", "hello", "==-", "aaab", " ", "thethe"]) * 800).encode()[: r.randint(500, 3000)] if r.random() < 0.5 else bytes(r.choice(b"abcdet hino") for _ in range(2000))
        machine, out, at = bpe.Transducer(merges, block=64), b"", 0
        while at < len(data):
            n = r.randint(1, 300)
            out += machine.feed(data[at : at + n])
            at += n
            assert len(machine.held) <= machine.block + merges.lookahead
        assert out + machine.feed(b"", True) == packed(merges.encode_piece(data))
        assert not machine.held


def slow_merge(rules, text):
    """Pairs of least rank first, leftmost among equals, on strings."""
    parts = list(text)
    while found := [(rules[a, b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in rules]:
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def test_lookahead_suffices_for_small_merge_lists():
    """All texts of up to ten letters, cut anywhere, under hundreds of random merge lists: what the transducer
    emits before the cut stands whatever follows."""
    r = random.Random(3)
    for _ in range(150):
        letters = "ab" if r.random() < 0.5 else "abc"
        tokens, order = list(letters), []
        for _ in range(r.randint(1, 7)):
            a, b = r.choice(tokens), r.choice(tokens)
            if (a, b) not in order and len(a + b) <= 6 and a + b not in tokens:
                order.append((a, b))
                tokens.append(a + b)
        alphabet = {v: k for k, v in bpe.byte_alphabet().items()}
        vocab = {alphabet[i]: i for i in range(256)}
        for t in tokens[len(letters) :]:
            vocab[t] = len(vocab)
        m = bpe.Merges(json.dumps({"model": {"vocab": vocab, "merges": [" ".join(x) for x in order]}}))
        rules = {p: i for i, p in enumerate(order)}
        for _ in range(40):
            text = "".join(r.choice(letters) for _ in range(r.randint(1, 10)))
            want = [vocab[t] for t in slow_merge(rules, text)]
            machine = bpe.Transducer(m, block=1)
            out = b"".join(machine.feed(text[i : i + 1].encode()) for i in range(len(text)))
            assert packed(want[: len(out) // 4]) == out
            assert out + machine.feed(b"", True) == packed(want), (order, text)


def test_pre_tokens_in_parts(merges, library, monkeypatch):
    """Stretches of a few characters: long runs of every kind, cut anywhere, give the library's ids, all of
    them from the transducer."""
    for name, value in (("WINDOW", 7), ("PART", 5)):
        monkeypatch.setattr(bpe, name, value)
    emitted = []
    feed = bpe.Transducer.feed
    monkeypatch.setattr(bpe.Transducer, "feed", lambda self, *a: emitted.append(feed(self, *a)) or emitted[-1])
    encoder, r = bpe.Encoder(merges), random.Random(4)
    runs = ["a", "é", " ", "\n", "\t", "1", "²", "!", "'", "😀", "中", "'s", " \n", "a ", " a"]
    for _ in range(1500):
        text = "".join(r.choice(runs) * r.choice([1, 1, 2, 3, 11, 30]) for _ in range(r.randint(0, 6)))
        emitted.clear()
        ids = ids_of(encoder, text)
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert packed(ids) == b"".join(emitted)
        assert not encoder.tail and not encoder.run and len(encoder.machine.held) == 0


def test_memory_does_not_follow_the_text(merges, library):
    for unit in ("x", " ", "!", "7", "\n", "中"):
        encoder, most = bpe.Encoder(merges), 0
        out = []
        for _ in range(6):
            out.append(encoder.feed(unit * (1 << 16)))
            most = max(most, len(encoder.tail) + len(encoder.machine.held))
        out.append(encoder.finish())
        assert most <= bpe.PART + encoder.machine.block + merges.lookahead
        assert np.frombuffer(b"".join(out), "<u4").tolist() == library.encode(unit * 6 * (1 << 16), add_special_tokens=False).ids


def test_text_from_any_bytes(merges):
    by_byte = {v: k for k, v in merges.bytes_of.items() if len(v) == 1}
    r = random.Random(5)
    some = [0x20, 0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC1, 0xC2, 0xDF, 0xE0, 0xE4, 0xED, 0xEF, 0xF0, 0xF1, 0xF4, 0xF5, 0xFF]
    for _ in range(4000):
        data = bytes(r.choice(some) for _ in range(r.randint(0, 8)))
        back = bpe.ByteToText(merges)
        got = "".join(back.feed([by_byte[bytes([b])]]) for b in data)
        assert len(back.held) <= 3
        assert got + back.finish() == data.decode("utf-8", "replace"), data


def test_invalid_bytes_decode_to_replacements(merges):
    by_byte = {v: k for k, v in merges.bytes_of.items() if len(v) == 1}
    back = bpe.ByteToText(merges)
    assert back.feed([by_byte[b"\xe4"], by_byte[b"\xb8"]]) + back.feed([by_byte[b"a"]]) + back.finish() == "�a"


def test_tokens_of_odd_rows(odd, library):
    rows = bpe.bpe_round_trip(odd, bpe.default_vocabulary()).collect()
    texts = [r.text or "" for r in odd.select("text").collect()]
    assert [r.ids for r in rows] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [r.decoded for r in rows] == texts and [r.n_tokens for r in rows] == [len(r.ids) for r in rows]
    assert rows[0].ids_sha256 == hashlib.sha256(np.array(rows[0].ids, "<u4").tobytes()).hexdigest()
    assert bpe.bpe_round_trip(odd.limit(0), bpe.default_vocabulary()).count() == 0


# ---- fingerprints


def slow_leaves(text):
    """Sections of lines of runs of words, cut character by character."""
    lines, line = [], ""
    for c in text:
        if line.endswith("\r") and c != "\n" or line and line[-1] in "\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029":
            lines.append(line)
            line = ""
        line += c
    lines += [line] if line else []
    out = []
    for line in lines:
        runs, run, words = [], "", 0
        for word in re.findall(r"\s*\S+\s*", line) or [line]:
            run, words = run + word, words + 1
            if words == 16 or words >= 8 and word.rstrip()[-1:] in {".", "!", "?"}:
                runs.append(run)
                run, words = "", 0
        out.append([*runs, run] if run else runs)
    return out


def slow_tree(text):
    """(root, leaves' digests) by the definition."""
    def digest(data, what, size=12):
        return hashlib.blake2b(data, digest_size=size, person=what).digest()

    sections, current, leaves = [], [], []
    for line in slow_leaves(text):
        mine = [digest(x.encode(), b"leaf") for x in line]
        leaves += mine
        current.append(digest(b"".join(mine), b"node"))
        if not "".join(line).strip() or int.from_bytes(current[-1][:4], "big") % 16 == 0:
            sections.append(digest(b"".join(current), b"node"))
            current = []
    if current:
        sections.append(digest(b"".join(current), b"node"))
    return digest(b"".join(sections), b"node", 16).hex(), leaves


def test_trees_are_those_of_the_definition(documents):
    r = random.Random(6)
    texts = [x.text or "" for x in documents.select("text").limit(60).collect()]
    texts += ["".join(r.choice(["a", "bc", " ", " ", "\n", ". ", "!", "?\n", "\n\n", "\r\n", "\t", "é"]) for _ in range(r.randint(0, 200))) for _ in range(400)]
    seen = {}
    for t in texts:
        root, leaves = slow_tree(t)
        found = merkle.tree(t)
        assert found.root == root and [x for s in found.sections for _, ls in s for x in ls] == leaves, t
        assert merkle.parse(str(found)).sections == found.sections
        assert seen.setdefault(str(found), t) == t
    for a, b in zip(texts, texts[1:] + texts[:1], strict=True):
        x, y = (collections.Counter(slow_tree(t)[1]) for t in (a, merkle.edited(a, b)))
        both = x.total() + y.total()
        want = 2 * (x & y).total() / both if both else 1.0
        assert merkle.likeness(merkle.tree(a), merkle.tree(merkle.edited(a, b))) == want


def test_branches_are_proved():
    text = "\n".join(f"Paragraph {i} says something. And more of it." for i in range(80)) + "\n\nLast."
    found, lines = merkle.tree(text), text.splitlines(keepends=True)
    places = [(i, j) for i, s in enumerate(found.sections) for j in range(len(s))]
    for line, (i, j) in zip(lines, places, strict=True):
        shown = merkle.proof(found, i, j)
        assert merkle.proves(found.root, line, shown) and not merkle.proves(found.root, line + "x", shown)
    assert len(found.sections) > 2 and not merkle.proves(merkle.tree("else").root, lines[0], merkle.proof(found, 0, 0))
    with pytest.raises(ValueError):
        merkle.parse(merkle.fingerprint("a b c")[:32] + merkle.fingerprint("a b d")[32:])


def test_trees():
    a = "First one here. Second one there!\n\nA new section starts. It goes on.\nAnd ends."
    assert merkle.fingerprint(a) == merkle.fingerprint(a) != merkle.fingerprint(a + " ")
    b = a.replace("goes on", "stops")
    pa, pb = merkle.tree(a), merkle.tree(b)
    assert 0.5 < merkle.likeness(pa, pb) < 1 and merkle.likeness(pa, pb) == merkle.likeness(pb, pa)
    lines = a.splitlines()
    assert [lines[j if i == 0 else j + 2] for i, j in merkle.differing(pa, pb)] == ["A new section starts. It goes on."]
    assert merkle.likeness(pa, merkle.tree("Nothing in common")) == 0 and merkle.differing(pa, pa) == []
    assert merkle.likeness(merkle.tree(""), merkle.tree(None)) == 1 and merkle.likeness(merkle.tree(""), pa) == 0


def test_fingerprints_follow_the_order(spark, documents, odd, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 30)
    rows = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in merkle.fingerprints(documents).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        m = len(t) // 4
        e = t[: len(t) - m] + n[:m]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (merkle.fingerprint(t), merkle.fingerprint(e))
        assert r.near_next == merkle.likeness(merkle.tree(t), merkle.tree(n)) and 0 <= r.near_edited <= 1


@pytest.mark.parametrize("range_rows", [3, 5000])
def test_odd_rows_follow_the_order(spark, odd, monkeypatch, range_rows):
    """Repeated and null ids, an outlier and ids as text."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", range_rows)
    few = spark.createDataFrame([(1 << 62, "far away")] + [(None, f"null {i}") for i in range(20)] + [(5, f"five {i}") for i in range(20)], "doc_id long, text string")
    for df in (odd.select("doc_id", "text"), few, few.withColumn("doc_id", F.col("doc_id").cast("string"))):
        rows = [tuple(r) for r in df.select("doc_id", F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
        got = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in merkle.fingerprints(df).collect())
        want = collections.Counter((i, len(t), hashlib.sha256(merkle.edited(t, n).encode()).hexdigest()) for (i, t, _), (_, n, _) in zip(rows, rows[1:] + rows[:1], strict=True))
        assert got == want
    assert merkle.fingerprints(odd.limit(0)).count() == 0 and merkle.fingerprints(odd.where("doc_id = 7")).count() == 1
    assert merkle.fingerprints(odd.where("doc_id is null")).count() == 2


# ---- web records


def test_records(spark):
    page = '<html lang="fr"><head><title>A &amp; B</title><style>p{}</style></head><body><script>x="</p>"</script><p>One&nbsp;two<br>three</p><!-- no --><div><a href="/x?a=1&amp;b">link</a></div></body></html>'
    assert warc.plain_text(page) == "A & B\nOne two\nthree\nlink"
    assert warc.read_page(page) == {"title": "A & B", "lang": "fr", "outlinks": ["/x?a=1&b"], "text": "A & B\nOne two\nthree\nlink"}
    meta, text = warc.derive("http://h/", "2020-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\n\r\n", page, "<urn:uuid:r>")
    assert meta["refers_to"] == text["refers_to"] == "<urn:uuid:r>" and meta["concurrent_to"] == text["record_id"] and text["concurrent_to"] == meta["record_id"]
    assert text["payload_digest"] == warc.digest(page.encode()) and text["block_digest"] == warc.digest(text["block"].encode())
    head, _, block = warc.serialise(text).partition(b"\r\n\r\n")
    assert block == text["block"].encode() + b"\r\n\r\n" and f"Content-Length: {text['n_bytes']}".encode() in head and b"WARC-Refers-To: <urn:uuid:r>" in head
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<" * 50000 + "<a" * 20000 + "<!--" * 9000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(0)).withColumn("record_id", F.lit(0))
    got = warc.derivatives(df).collect()
    assert len(got) == 10 and len({r.record_id for r in got if r.page_id == 1}) == 2
    assert all(r.block_digest == warc.digest(r.block.encode()) and r.n_bytes == len(r.block.encode()) for r in got)
    assert warc.derivatives(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["<head>", "<title>", "<![CDATA[", "<!--", "<!", "<?", "<a href=\"", "<a href='x", "<script>", "<html lang=", "</title ", "</script ", "<", "<p", "&amp", "&#", " ", "<title>x</title ><head>"])
def test_long_pages_take_linear_time(unit):
    page = unit * (1_000_000 // len(unit))
    began = time.process_time()
    warc.derive("u", "", "", page)
    assert time.process_time() - began < 3  # a second or less on an idle machine


def test_open_constructs():
    assert warc.plain_text("a<!-- b <p>c") == warc.plain_text("a<script>c</p>") == warc.plain_text("a<![CDATA[ b") == "a"
    assert warc.plain_text("a <title>b <p>c") == "a\nb\nc"
    assert warc.plain_text("1 < 2 <p>3 <4") == "1 < 2\n3 <4"
    assert warc.plain_text("<head><script>'</head>'</script><title>t</title></head><body>x") == "t\nx"
    assert warc.read_page("<A HREF=x>1</A><a data-href=y>2</a><a\nhref='z'>3")["outlinks"] == ["x", "z"]


def test_responses_are_read_from_files(spark, tmp_path):
    """A file made by hand: what is read gives the records that its pages give directly."""
    def record(kind, uri, block, **more):
        lines = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uri}>", "WARC-Target-URI": uri, "WARC-Date": "2021-02-03T04:05:06Z", "Content-Length": str(len(block)), **more}
        return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    page = "<title>Zoë</title><p>1 € <a href=/n>n</a>"
    plain = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    latin = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n"
    chunked = "HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n"
    packed = gzip.compress(page.encode())
    data = record("warcinfo", "i", b"x: y\r\n") + record("response", "a", plain.encode() + page.encode()) + record("request", "a", b"GET /")
    data += record("response", "b", latin.encode() + "é".encode("latin-1")) + record("response", "c", chunked.encode() + b"5\r\n" + packed[:5] + b"\r\n%x;e=1\r\n" % (len(packed) - 5) + packed[5:] + b"\r\n0\r\n\r\n")
    (tmp_path / "one.warc").write_bytes(data)
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(record("response", "d", b"")) + gzip.compress(record("response", "e", plain.encode() + page.encode())[:-20]))
    (tmp_path / "none.warc").write_bytes(b"")
    found = warc.responses(spark.read.format("binaryFile").load(str(tmp_path)))
    rows = {r.url: r for r in found.collect()}
    assert {u: (r.headers, r.html) for u, r in rows.items()} == {"a": (plain, page), "b": (latin, "é"), "c": (chunked, page), "d": ("", "")}
    derived = warc.derivatives(found, "url", "url", "html", "date", "headers", "response_id").collect()
    assert len(derived) == 8
    for r in derived:
        assert r.refers_to == f"<urn:uuid:{r.url}>" and r.date == "2021-02-03T04:05:06Z" and r.source_headers == rows[r.url].headers
        (fields, block), = warc.parse_warc(bytes(r.record))
        assert fields["warc-type"] == r.warc_type and block == r.block.encode() and fields["warc-refers-to"] == r.refers_to
        assert json.loads(fields["x-source-http-headers"]) == r.source_headers
    assert warc.responses(spark.createDataFrame([(None,), (b"junk",)], "content binary")).count() == 0


def test_text_is_what_a_parser_shows(spark, sf):
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.text, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "noscript", "template")
            self.text.append(" ")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "noscript", "template")
            self.text.append(" ")

        def handle_data(self, data):
            if not self.skip:
                self.text.append(data)

    for r in spark.read.parquet(f"{sf}/pages.parquet").limit(60).collect():
        p = Words()
        p.feed(r.html)
        p.close()
        assert "".join(warc.plain_text(r.html).split()) == "".join("".join(p.text).split())


# ---- lines


def slow_lines(docs, threshold=2, min_chars=9):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    key = lambda i, n: (i is not None, i or 0, n)
    first, places = {}, []
    for i, t in sorted(docs, key=lambda d: key(d[0], 0)):
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                places.append((i, n, line))
                first.setdefault(line, key(i, n))
    long = [x for x in first if len(x) >= min_chars]
    near = {x: [y for y in long if y != x and abs(len(x) - len(y)) <= threshold and distance(x, y) <= threshold] for x in long}
    out = {i: [len((t or "").split("\n")), 0, 0, 0, []] for i, t in docs}
    for i, n, line in places:
        o = out[i]
        if first[line] != key(i, n):
            o[1] += 1
            o[4].append(n)
        else:
            o[3] += len(near.get(line, ()))
            if any(first[y] < first[line] for y in near.get(line, ())):
                o[2] += 1
                o[4].append(n)
    return {i: (*o[:4], ",".join(map(str, sorted(o[4])))) for i, o in out.items()}


def altered(r, s, n):
    b = list(s)
    for _ in range(n):
        k, x = r.randrange(len(b)), r.random()
        if x < 0.33:
            b[k] = r.choice("abcdef é")
        elif x < 0.66:
            b.insert(k, r.choice("abcdef é"))
        else:
            del b[k]
    return "".join(b)


@pytest.mark.parametrize(("limit", "chunk"), [(10**6, 4096), (0, 3)])
def test_lines(spark, limit, chunk, monkeypatch):
    near = line_dedup.near_lines
    monkeypatch.setattr(line_dedup, "near_lines", lambda d, t: near(d, t, limit, chunk))
    r = random.Random(2)
    base = ["".join(r.choice("abcdef é") for _ in range(r.choice([8, 9, 10, 13, r.randint(20, 40)]))) for _ in range(40)]
    pick = lambda: r.choice([altered(r, r.choice(base), r.randint(0, 3)), r.choice(base), "short", " ", "", "ab"])
    docs = [(i, "\n".join(pick() for _ in range(r.randint(0, 8)))) for i in range(60)] + [(None, "short\n" + base[0]), (100, None), (101, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("h1", F.lit(1))
    found = line_dedup.line_dedup(df)
    assert {x[0]: tuple(x[3:]) for x in found.collect()} == slow_lines(docs)
    kept = {x.doc_id: x.text for x in line_dedup.without_lines(df, found).collect()}
    gone = {x.doc_id: set(x.removed.split(",")) for x in found.collect()}
    assert all(kept[i] == (None if t is None else "\n".join(s for n, s in enumerate(t.split("\n")) if str(n) not in gone[i])) for i, t in docs)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    r = random.Random(threshold)
    rows = []
    for _ in range(400):
        a = "".join(r.choice("abcé") for _ in range(r.randint(20, 30)))
        rows.append((a, altered(r, a, r.randint(0, 5))))
    df = spark.createDataFrame(rows, "a string, b string").where(F.abs(F.char_length("a") - F.char_length("b")) <= threshold)
    longer = F.char_length("a") >= F.char_length("b")
    df = df.select("a", "b", F.when(longer, F.col("a")).otherwise(F.col("b")).alias("long"), F.when(longer, F.col("b")).otherwise(F.col("a")).alias("short"))
    df = df.withColumn("got", line_dedup.banded_distance("long", "short", threshold)).withColumn("want", F.levenshtein("a", "b"))
    assert df.where(f"IF(want <= {threshold}, got <> want, got <= {threshold})").count() == 0
    s = df.withColumn("x", line_dedup.sketch("a")).withColumn("y", line_dedup.sketch("b"))
    flips = "bit_count(x.lo ^ y.lo) + bit_count(x.hi ^ y.hi)"
    assert s.where(f"want <= {threshold} and {flips} > {4 * threshold}").count() == 0


def test_lines_of_a_template_are_counted_not_paired(spark):
    """Six hundred lines of one template: every link is counted, and no table of pairs is written."""
    lines = [f"entry number {i:04} of the common template" for i in range(600)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in line_dedup.line_dedup(df).collect()}
    table = spark.createDataFrame(list(enumerate(lines)), "a long, x string")
    pairs = table.join(table.toDF("b", "y"), F.levenshtein("x", "y") <= 2).where("a <> b").groupBy("a").count()
    assert got == {r.a: r["count"] for r in pairs.collect()}


def test_lines_of_odd_rows(odd):
    rows = line_dedup.line_dedup(odd.where("doc_id is not null")).collect()
    assert sorted(r.doc_id for r in rows) == [1, 3, 3, 7, 8, 9, 10, 11, 12, 13, 13]
    got = {(r[0], r[2]): tuple(r[3:]) for r in rows}
    assert got[3, 0] == (1, 0, 1, 1, "0") and got[3, 1] == (1, 1, 0, 0, "0") and got[1, 0][:4] == (1, 0, 0, 1) and got[9, 0][0] == 2 and got[13, 0] == (1, 0, 0, 0, "")
    rows = line_dedup.line_dedup(odd).where("doc_id is null or doc_id = 3").collect()
    assert sorted((r.doc_id or 0, r.n_exact, r.removed) for r in rows) == [(0, 0, ""), (0, 0, ""), (3, 1, "0"), (3, 1, "0")]
    clean = line_dedup.without_lines(odd, line_dedup.line_dedup(odd))
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert clean.where("text = ''").count() == 4 and clean.where("doc_id = 3 and text = ''").count() == 2
    assert line_dedup.line_dedup(odd.limit(0)).count() == 0


# ---- repeats


def slow_repeats(rows, length=50):
    best = {}
    for i, t in rows:
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            best[w] = min(best.get(w, i), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if best[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        runs = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shard", [300, 1 << 16])
def test_merge_gives_least_owners_and_common_prefixes(shard, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", shard)
    r = random.Random(shard)
    for _ in range(12):
        length = r.choice([20, 50])
        base = bytes(r.choice(b"ab\x00\xff") for _ in range(200))
        strings = set()
        for _ in range(r.randint(1, 40)):
            x = bytearray(base[(i := r.randrange(100)) : i + r.randint(length, length + 34)])
            if r.random() < 0.5:
                x[r.randrange(len(x))] = r.randrange(256)
            strings.add(bytes(x))
        strings = sorted(s for s in strings if len(s) >= length)
        owner = np.array([r.randint(0, 20) for _ in strings])
        best = {}
        for s, o in zip(strings, owner, strict=True):
            for k in range(len(s) - length + 1):
                best[s[k : k + length]] = min(best.get(s[k : k + length], 99), o)
        assert repeats.least_owners(strings, owner, length).tolist() == [best[s[k : k + length]] for s in strings for k in range(len(s) - length + 1)]
    shards = [repeats.ShardBwt([b"banana" * 12, b"bandana" * 9]), repeats.ShardBwt([b"ananas" * 11])]
    texts = []
    for s, strings in zip(shards, ([b"banana" * 12, b"bandana" * 9], [b"ananas" * 11]), strict=True):
        texts += [strings[a][o:] for a, o in zip(s.string[s.suffixes], s.offset[s.suffixes], strict=True)]
        keys = list(zip(texts[-len(s.bwt) :], s.string[s.suffixes], strict=True))
        assert keys == sorted(keys)
    offset = np.concatenate([s.offset[s.suffixes] for s in shards])
    order, common = repeats.merge([s.bwt for s in shards], 50, np.flatnonzero(offset >= 50))
    windows = [texts[i][:50] for i in order]
    assert windows == sorted(windows) and sorted(order.tolist()) == [i for i, t in enumerate(texts) if len(t) >= 50]
    assert [*common.tolist()] == [False, *(a == b for a, b in zip(windows, windows[1:]))]


@pytest.mark.parametrize("hot", [1, 50_000])
def test_repeats(documents, odd, spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = [(r.doc_id, r.text.encode()) for r in documents.select("doc_id", "text").collect()]
    assert sorted(tuple(x) for x in repeats.remove_repeats(documents, write=False).collect()) == slow_repeats(rows)
    r = random.Random(9)
    passage = "".join(r.choice("abcdefg é") for _ in range(400))
    made = [(r.choice([None, i, i, 5]), passage[r.randrange(200) : 200 + r.randrange(200)] * r.randint(0, 3) + "x" * r.randint(0, 120)) for i in range(40)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3).withColumn("mark", F.lit(0)).withColumn("to", F.lit("q"))
    for frame in (df, odd):
        last = repeats._LAST
        rows = [(last if x.doc_id is None else x.doc_id, (x.text or "").encode()) for x in frame.select("doc_id", "text").collect()]
        got = repeats.remove_repeats(frame).collect()
        assert sorted((last if x[0] is None else x[0], *x[1:5]) for x in got) == slow_repeats(rows)
        assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 for x in got)
    assert repeats.remove_repeats(odd.limit(0)).count() == 0


def test_largest_id_is_not_null(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(80))
    df = spark.createDataFrame([((1 << 63) - 1, text), (None, text), (5, text), ((1 << 63) - 1, None)], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.n_bytes, x.n_removed) for x in repeats.remove_repeats(df).collect())
    assert got == [(0, 80, 80), (5, 80, 0), ((1 << 63) - 1, 0, 0), ((1 << 63) - 1, 80, 80)]


def test_hot_keys_are_dealt_again():
    r = random.Random(4)
    texts = [bytes(r.choice(b"abc") for _ in range(300)) for _ in range(20)] + [b"x" * 200]
    for d, a, n, k in repeats.runs(texts, 50):
        e, b, m, both = repeats._dealt_again(texts, d, a, n, k, 50)
        windows = lambda d, a, n: [texts[i][p + q : p + q + 50] for i, p, c in zip(d, a, n, strict=True) for q in range(c)]
        assert sorted(windows(e, b, m)) == sorted(windows(d, a, n))
        keys = collections.defaultdict(set)
        for i, p, c, y in zip(e, b, m, both, strict=True):
            for q in range(c):
                keys[texts[i][p + q : p + q + 50]].add(int(y))
        assert all(len(x) == 1 for x in keys.values()) and len(set(both.tolist())) > len(set(k.tolist()))


# ---- mixing


def targets(n, r):
    """Weights of n sources that add up to 1, as decimals, some of them hundreds of times the others."""
    parts = [r.choice([1, 1, 2, 7, 40, 300]) for _ in range(n)]
    return {f"s{i}": Fraction(p, sum(parts)) for i, p in enumerate(parts)}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 100, 1000])
def test_pfair_follows_the_targets(n):
    """At every slot each source has had its target share, within less than one block."""
    r = random.Random(n)
    for weights in ([targets(n, r)] if n > 1 else [{"s0": 0.3}]) + ([{"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 1, "b": 0.5 / 3}, {"a": 910, **{f"x{i}": 10 for i in range(9)}}] if n == 3 else []):
        exact = {x: Fraction(w) if isinstance(w, (int, Fraction)) else Fraction(str(w)) for x, w in weights.items()}
        total = sum(exact.values())
        names, share = list(exact), np.array([w / total for w in exact.values()], object)
        whole, near = mixing.whole_weights(weights), share.astype(float)
        assert all(Fraction(whole[x], sum(whole.values())) == w for x, w in zip(names, share, strict=True))
        place, seen = {x: i for i, x in enumerate(names)}, np.zeros(len(names))
        for t, (x, k) in enumerate(islice(mixing.pfair(whole), 3000)):
            assert seen[place[x]] == k and k / share[place[x]] < t + 1 and t < (k + 1) / share[place[x]]
            seen[place[x]] += 1
            worst = int(np.argmax(abs(seen - (t + 1) * near)))
            assert abs(int(seen[worst]) - (t + 1) * share[worst]) < 1
    for bad in ({}, {"a": 0}, {"a": math.inf}, {"a": -1, "b": 2}):
        with pytest.raises(ValueError):
            mixing.whole_weights(bad)


def slow_schedule(weights, blocks):
    """The slot of every block: at each slot the released block that is due first, by exact fractions."""
    total, had, out, empty = sum(weights.values()), dict.fromkeys(weights, 0), {}, math.inf
    t = 0
    while len(out) < sum(blocks.values()):
        ready = [(math.ceil((had[x] + 1) / (w / total)), x) for x, w in weights.items() if had[x] / (w / total) < t + 1]
        x = min(ready)[1]
        if had[x] < blocks.get(x, 0):
            out[x, had[x]] = t
        else:
            empty = min(empty, t)
        had[x] += 1
        t += 1
    return out, empty


@pytest.mark.parametrize("slice_", [1 << 20, 50])
def test_mix(documents, odd, monkeypatch, slice_):
    monkeypatch.setattr(mixing, "FEWEST_ROWS", 30)
    monkeypatch.setattr(mixing, "SLICE", slice_)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", slice_)
    names = [r.source for r in documents.select("source").distinct().orderBy("source").collect()]
    weights = {x: Fraction(1 + 3 * i, 7) for i, x in enumerate(names)} | {"none of it": Fraction(1, 11)}
    got = mixing.mix(documents, weights, block_rows=2).collect()
    assert len(got) == documents.count() == len({r.position for r in got})
    by = {}
    for r in documents.select("doc_id", "source").orderBy("doc_id").collect():
        by.setdefault(r.source, []).append(r.doc_id)
    at, empty = slow_schedule(weights, {x: -(-len(v) // 2) for x, v in by.items()})
    for r in got:
        n, w = by[r.source].index(r.doc_id), weights[r.source] / sum(weights.values())
        assert r.block == n // 2 and r.slot == at[r.source, r.block] and r.position == 2 * r.slot + n % 2
        assert r.release == math.floor(r.block / w) <= r.slot < r.deadline == math.ceil((r.block + 1) / w)
        assert r.backlogged == (r.slot < empty)
    by_default = mixing.mix(documents, block_rows=2).collect()
    assert any(r.backlogged for r in by_default) and len(by_default) == len(got)
    assert not all(r.backlogged for r in got)
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and {r.source for r in rows} == {"", "a", "b", "c"}
    assert mixing.mix(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, {"a": 1.0})
    ordered = mixing.in_mixed_order(odd)
    assert ordered.columns == odd.columns and ordered.count() == odd.count()


def test_ranges_of_outliers_and_nulls(spark):
    """An outlier, an id that half the rows share and null ids leave ranges of about equal size, in order."""
    ids = [*range(3000), 1 << 60, *[5000] * 3000, *[None] * 2000]
    df = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "i long, t string").withColumn("h", F.xxhash64("t"))
    found = ranges.Ranges(df, "i", 400)
    rows = df.withColumn("p", found.number(F.col("i"), F.col("h"))).collect()
    sizes = collections.Counter(r.p for r in rows)
    assert found.parts == 21 and max(sizes.values()) < 1000 and max(sizes) < found.parts
    ends = {}
    for r in sorted(rows, key=lambda r: (r.p, r.i is not None, r.i or 0, r.h)):
        ends.setdefault(r.p, []).append((r.i is not None, r.i or 0, r.h))
    assert all(ends[a][-1] <= ends[b][0] for a, b in zip(sorted(ends), sorted(ends)[1:]))
    words = spark.createDataFrame([(x,) for x in ["b", "a", None, "é", "z"] * 40], "i string").withColumn("h", F.lit(0).cast("long"))
    got = {r.i: r.p for r in words.withColumn("p", ranges.Ranges(words, "i", 30).number(F.col("i"), F.col("h"))).collect()}
    assert [got[x] for x in (None, "a", "b", "z", "é")] == sorted(got.values())
    backwards = mixing.ranks(df.select("i", F.lit("s").alias("s")), "i", "s").collect()
    assert sorted(r._n for r in backwards) == list(range(len(ids)))
    assert [r.i for r in sorted(backwards, key=lambda r: r._n)] == sorted(ids, key=lambda i: (i is not None, i or 0))
