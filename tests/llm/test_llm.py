"""The operators against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and further columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import tracemalloc
import zlib
from collections import Counter
from math import comb

import brute
import numpy as np
import pytest
from hypothesis import example, given, settings, strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import chat, imatch, kernels as K, language, mixing, near, packing, quality, queries, repeats as R, substrings, suffixes, warc
from tidewatch.plans.lineage import stage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, shard int, kept string, n long, length string"


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "the", "re", "é", "ou", "ß"]) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    rows: list[tuple[int | None, str | None]] = [(None, None), (1, ""), (2, None), (3, " \n\t "), (4, "one"), (5, "two words"), (6, "one two three four")]
    base = [" ".join(word() for _ in range(rng.randint(20, 300))) for _ in range(20)]
    for k, t in enumerate(base):
        rows.append((10 + k, t))
    for k in range(8):
        words = base[k].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((40 + k, " ".join(words)))
        rows.append((60 + k, f"{base[k + 8]} {passage} {base[k + 9]}"))
        rows.append((80 + k, base[2]))
    rows.append((100, "ab " * 3000))
    rows.append((101, " ".join(word() for _ in range(30_000))))
    rows.append((102, "\x1c separator no space\x85 ünïcode 𝄞𝄞 " * 10))
    rows += [(80, base[2]), (12, base[2]), (12, base[3]), (None, base[4]), (None, base[4])]
    rows.append((-7, passage))
    return rows


def frame(spark, rows):
    full = [(d, t, ["en", None, "fr"][k % 3], ["a", "b", None, "é"][k % 4], len(t or ""), "x", k, "y", k, "z") for k, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return stage(frame(spark, texts()))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def found(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_words_are_runs_without_ascii_white_space(spark):
    import pyarrow as pa

    rows = [t for _, t in texts()]
    data, offsets = K.flat(pa.array(rows, pa.string()))
    starts, ends, first = K.words(data, offsets)
    raw = data.tobytes()
    for r, t in enumerate(rows):
        assert [raw[a:b].decode() for a, b in zip(starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]])] == brute.WORD.findall(t or "")


# 1


def test_suffix_dedup(docs):
    assert found(suffixes.digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffixes(texts()), key=str)


def test_suffix_dedup_of_nothing(nothing):
    assert suffixes.digest(nothing).count() == 0 and suffixes.trim(nothing).columns == nothing.columns


def test_trim_keeps_columns(docs):
    trimmed = suffixes.trim(docs)
    assert trimmed.columns == docs.columns
    want = sorted((str(d), len(bytes(b for b, g in zip(s, gone) if not g).decode("utf-8", "ignore"))) for d, s, gone in brute.covered([(d, (t or "").encode()) for d, t in texts()], bytes, 50))
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in trimmed.collect()) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=200), st.integers(0, 3))
def test_suffix_order(symbols, spill):
    held, suffixes.SPILL = suffixes.SPILL, 1 + 7 * spill  # queues on disk too
    try:
        text = np.array([*symbols, 0], np.uint16)
        order = suffixes.suffix_order(text, len(text)).tolist()
    finally:
        suffixes.SPILL = held
    assert order == sorted(range(len(text)), key=lambda i: text[i:].tolist())


# 2


def test_chat(spark):
    rows = [(1, 1, "assistant", "a<b[c\\l"), (1, 0, "user", None), (1, None, "system", "s"), (2, 0, None, "x"), (3, 0, "assistant", "y" * 200_000), (3, 1, "assistant", "<|end|>\n" * 9)]
    rows += [(None, 0, "user", "n"), (1, 0, "user", None)]
    turns = spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(turns)).collect()}
    assert len(got) == 4
    for conv_id, r in got.items():
        own = sorted((x for x in rows if x[0] == conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        learned = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(learned) and r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
    assert chat.read_back(chat.formatted(turns.limit(0))).count() == 0


@given(st.text())
def test_escaping_can_be_taken_back(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and "<" not in escaped and "[" not in escaped


def test_template_compiler():
    run = chat.compiled("{% if 'a' + 'b' == 'ab' %}x{{ 'y' | trim }}{% endif %}{% for message in messages %}{% if not loop.first %}, {% endif %}{{ message.content }}{% if loop.last %}.{% endif %}{% endfor %}")
    assert "".join(t for t, _ in run([{"message.role": "u", "message.content": c} for c in "abc"])) == "xya, b, c."
    assert chat.parse("a{{ 'b' }}{% if true %}c{% endif %}") == [("text", "abc")]
    for bad in ("{{ os }}", "{{ message.__class__ }}", "{% for x in y %}{% endfor %}", "{{ 'a' | eval }}", "{% if true %}", "{{ f() }}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)


# 3


def test_substring_dedup(docs):
    assert found(substrings.digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substrings(texts()), key=str)


def test_paths_lead_to_equal_words(docs, nothing):
    words = {}
    for d, t in texts():
        words.setdefault(d, []).append(brute.WORD.findall(t or ""))
    paths = substrings.paths(docs).collect()
    assert paths and any(p["n_edges"] > 40 for p in paths)
    for p in paths:
        own = [w[p["start"] : p["start"] + p["n_edges"] + 12] for w in words[p["doc_id"]]]
        source = [w[p["source_start"] : p["source_start"] + p["n_edges"] + 12] for w in words[p["source_doc"]]]
        assert any(x == y for x in own for y in source)
    assert substrings.digest(nothing).count() == 0


# 4


def test_revisits(spark):
    full = [
        (1, "http://www.A.com/x/?b=2&a=1&utm_source=q", 10, "response", {"ETag": '"1"', "Content-Type": "t", "Date": "d"}, "one"),
        (2, "https://a.com/x?a=1&b=2#f", 20, "response", {"ETag": '"2"'}, "two"),
        (3, "a.com/x?a=1&b=2", 20, "response", {"ETag": '"3"', "Set-Cookie": "c"}, "three"),
        (4, "http://a.com/x?a=1&b=2", 20, "revisit", {"etag": 'W/"1"', "DATE": "e", "set-cookie": "no"}, None),
        (5, "http://a.com/x?a=1&b=2", 99, "revisit", {"etag": '"3"', "age": "5"}, None),
        (6, "http://a.com/x?a=1&b=2", 99, "revisit", {"etag": '"9"'}, None),
        (7, "http://a.com/y", 99, "revisit", {"etag": '"9"'}, None),
        (8, None, 99, "revisit", None, None),
        (9, "http://a.com/x?a=1&b=2", 5, "revisit", {}, None),
        (10, "http://a.com/x?a=1&b=2", 30, "revisit", {}, None),
        (10, "http://a.com/x?a=1&b=2", 30, "revisit", {}, None),
    ]
    records = spark.createDataFrame([(*r, "k") for r in full], "record_id long, url string, ts long, kind string, headers map<string,string>, body string, slice string")
    for width in (1, 7, 4096):
        got = {r["record_id"]: r for r in warc.resolve(records, width).collect()}
        assert got[4]["status"] == "resolved" and got[4]["body"] == "one"
        assert got[4]["headers"] == {"etag": 'W/"1"', "content-type": "t", "date": "e"}
        assert got[5]["body"] == "three" and got[5]["headers"] == {"etag": '"3"', "set-cookie": "c", "age": "5"}
        assert [got[k]["status"] for k in (6, 7, 8, 9, 10)] == ["changed", "no_response", "no_response", "no_response", "no_validator"]
        assert got[6]["body"] is None
    assert warc.resolve(records).count() == 8 and warc.resolve(records.limit(0)).count() == 0


# 5


def goals(size: dict, weights=(5, 2, 1)) -> dict:
    """Targets by filling up: whoever is above three times its size stops there."""
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, stopped = sum(size.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        rest, share = total - sum(stopped.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / share > 3 * size[s]]
        if not over:
            return stopped | {s: rest * weight[s] / share for s in free}
        stopped |= {s: 3 * size[s] for s in over}


def test_mixing(docs, nothing):
    rows = docs.select("doc_id", "text", "source").collect()
    size = Counter()
    for r in rows:
        size[r["source"]] += len(brute.WORD.findall(r["text"] or ""))
    want = goals(size)
    sized = stage(mixing.sizes(docs))
    got = mixing.taken(sized).collect()
    assert len(got) == len(rows)
    taken = Counter()
    of = {x["target"]: s for s in want for x in got if abs(want[s] - x["target"]) < 1e-6 and x["source_size"] == size[s]}
    for r in got:
        taken[of[r["target"]]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    longest = Counter()
    for r in rows:
        longest[r["source"]] = max(longest[r["source"]], len(brute.WORD.findall(r["text"] or "")))
    assert all(abs(taken[s] - want[s]) <= (0.02 * want[s] + 20 if longest[s] < 1000 else longest[s] / 2) for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(sized.repartition(5)).collect()))
    assert mixing.taken(mixing.sizes(nothing)).count() == 0
    again = mixing.repeat(docs)
    assert again.columns == docs.columns and sum(len(brute.WORD.findall(r["text"] or "")) for r in again.collect()) == sum(taken.values())


def test_shards_get_their_quotas(spark, docs):
    counts = spark.createDataFrame([(k, n) for k, n in enumerate([1000, 300, 7, 0, 2501])], "rank long, n long")
    quota = mixing.quotas(counts, 3).toPandas().pivot(index="shard", columns="rank", values="n")
    assert quota.sum().tolist() == [1000, 300, 7, 0, 2501] and quota.shape == (8, 5) and quota.sum(axis=1).between(475, 477).all() and (quota >= 0).all().all()
    drawn, copies = mixing.mix(stage(mixing.sizes(docs)), block=500, shard=5000)
    assert copies.groupBy("shard").count().count() > 4
    assert copies.count() == drawn.agg(F.sum("copies")).first()[0]
    place = copies.groupBy("shard").agg(F.max("place").alias("p"), F.countDistinct("place").alias("n")).collect()
    assert all(r["p"] + 1 == r["n"] for r in place)


def test_hypergeometric(spark):
    uniform = F.pmod(F.xxhash64("id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    got = spark.range(4000).select(mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(10), uniform).alias("k")).groupBy("k").count().collect()
    for r in got:
        want = 4000 * comb(20, r["k"]) * comb(30, 10 - r["k"]) / comb(50, 10)
        assert abs(r["count"] - want) < 5 * want**0.5 + 1


# 6


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    path = queries.tokenizer()
    encode = Tokenizer.from_file(path).encode
    pieces = packing.pack(stage(packing.tokenise(docs, path, keep_ids=True))).toPandas()
    want = Counter()
    for d, t in texts():
        ids = [*encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4").tobytes()
            want[(str(d), k // 4096, k, len(part) // 4, zlib.crc32(part))] += 1
    got = Counter((str(None if np.isnan(r.doc_id) else int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in pieces.itertuples())
    assert got == want
    check_places(pieces.sequence_id.to_numpy(), pieces.offset.to_numpy(), pieces.length.to_numpy(), 4096)
    assert packing.pack(packing.tokenise(nothing, path)).count() == 0


def check_places(sequence, offset, length, capacity):
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], length[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    assert (o[new] == 0).all() and (o[1:][~new[1:]] == (o + n)[:-1][~new[1:]]).all() and (o + n).max() <= capacity


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), min_size=1, max_size=40))
@example({34: 7, 67: 5})
def test_plans(counts):
    slots, n = packing.plan(counts, 100)
    places = [(base + i, at, length) for length, _, size, base, at in slots.tolist() for i in range(size)]
    check_places(*(np.array(x) for x in zip(*places)), 100)
    for length, have in counts.items():
        assert sorted(r for x, rank, size, _, _ in slots.tolist() if x == length for r in range(rank, rank + size)) == list(range(have))
    low = -(-sum(k * v for k, v in counts.items()) // 100)
    # Neither the sum nor the number of long pieces says how many are needed: 34 seven times and 67 five times take nine.
    assert n == len({p[0] for p in places}) and n <= max(low + 2, 1.25 * max(low, sum(v for k, v in counts.items() if k > 50)) + 1, 1.05 * first_fit(counts, 100) + 1)


def first_fit(counts, capacity):
    """Sequences that first fit, longest first, takes."""
    room = []
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        k = next((k for k, x in enumerate(room) if x >= length), len(room))
        room[k:k + 1] = [(room[k] if k < len(room) else capacity) - length]
    return len(room)


def test_special_tokens_and_case():
    path = queries.tokenizer()
    encode = packing.ids_at(path).tokenizer.encode
    for text in ("A<|endoftext|>b", "<|ENDOFTEXT|> x", "Don't STOP... now.,x.", "É é, 12.5.", "\x1c  x\x85y", "a" * 500):
        ids = packing.ids_at(path).of([text.encode()])[0]
        assert np.frombuffer(ids, "<u4").tolist() == encode(text, add_special_tokens=False).ids


def test_ids_of_signs_and_marks():
    ids = packing.Ids(queries.tokenizer())
    caron, ring, both = "J\u030c j\u030c", "W\u030aY\u030a", "T\u0344."  # small letters combine with these marks, capitals don't
    texts = [caron, ring, both, "ones***", "don't!'s a.'re,'LL", "f\xfcr\xf7\xb5. \xc9t\xe9=\u0338", "a.b@c-d's;<|x|>", "", " \n", "x" * 70 + "\xe9, " + "x" * 70, "1a,2.b", "K\u0323."]
    for _ in range(2):  # learnt, and remembered
        got = [np.frombuffer(x, "<u4").tolist() for x in ids.of([t.encode() for t in texts])]
        assert got == [ids.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(map(len, ids.known)) <= packing.LONGEST and ids.bounds[-1] == len(ids.ids) and len(ids.bounds) == len(ids.known) + 1


def test_new_words_are_encoded_together():
    ids, texts = packing.Ids(queries.tokenizer()), []
    tokenizer = ids.tokenizer

    class Spy:
        def encode_batch_fast(self, batch, **options):
            texts.extend(batch)
            return tokenizer.encode_batch_fast(batch, **options)

    ids.tokenizer = Spy()
    words = ["".join(x) for x in itertools.product("abcdefghij", repeat=3)]
    text = " ".join(w + sign for w in words for sign in ("", ".", "***", ";"))
    (got,) = ids.of([text.encode()])
    assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(texts) <= 20


# 7


def base(text: str) -> tuple:
    words = brute.WORD.findall(text)
    seen, twice = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2)), set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            twice |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if brute.WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice)


def test_base_rules(spark, nothing):
    rows = [*texts(), (200, "a | b\na | b\n\n \n c#\nc#\nc#"), (201, "\nx\n\nx\n"), (202, "one two three " * 40)]
    got = quality.judge(frame(spark, rows), None).collect()
    want = sorted(((d, *base(t or "")) for d, t in rows), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got), key=str) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == (not r["base_failed"]) for r in got)
    assert quality.judge(nothing, None).count() == 0


def test_classifier(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["the", "river", "runs", "over", "stones"]) + str(rng.randrange(30)) for _ in range(90)) for _ in range(120)]
    bad = [" ".join(rng.choice(["BUY", "NOW", "!!!", "click"]) + rng.choice("!|#") + str(rng.randrange(30)) for _ in range(90)) for _ in range(120)]
    table = frame(spark, list(enumerate(good + bad)))
    labels = spark.createDataFrame([*((k, int(k < 120), 0, "x") for k in range(0, 240, 2)), (0, None, 0, "x"), (None, 1, 1, "x"), (999, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    model = quality.fit(table, labels)
    got = quality.judge(table, model).collect()
    assert sum(r["kept"] == (r["doc_id"] < 120) for r in got) >= 236
    kept = quality.keep(table, model)
    assert kept.columns == table.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.fit(table, labels.limit(0)) is None


# 8


def test_fingerprints(docs, nothing, spark):
    rows = sorted(set(texts()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = imatch.fingerprints(docs).collect()
    assert len(got) == len(texts())
    shas = Counter(r["edited_sha256"] for r in got if r["doc_id"] in (1, 4, 100, 101, 102))
    order = spark.createDataFrame(texts(), "doc_id long, text string")
    order = [(r["doc_id"] if r["doc_id"] != R.NOBODY else None, r["text"]) for r in imatch.narrow(order).distinct().orderBy("doc_id", "h").collect()]
    for k, (d, t) in enumerate(order):
        q = len(t) // 4
        edited = t[: len(t) - q] + order[(k + 1) % len(order)][1][:q]
        assert any(r["doc_id"] == d and r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() for r in got)
    assert len(shas) == 5 and rows
    prints = {r["fingerprint"] for r in got if r["doc_id"] in (81, 82, 83)}
    assert len(prints) == 1 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert [r["near_next"] for r in got if r["doc_id"] in (81, 82)] == [1.0, 1.0]
    assert imatch.fingerprints(nothing).count() == 0


# 9


@pytest.mark.parametrize("small, depth", [(24, 8), (6, 8), (2, 8)])
def test_near_groups(docs, small, depth):
    got = near.groups(docs, small=small, depth=depth)
    assert found(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(texts()), key=str)


def test_a_crowd_of_near_copies_is_one_group(spark, nothing):
    rng = random.Random(8)
    base_text = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for k in range(150):
        words = list(base_text)
        words[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(words)))
    got = near.groups(frame(spark, rows)).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1
    kept = near.keep(frame(spark, rows))
    assert kept.count() == 1 and kept.columns == nothing.columns
    assert near.groups(nothing).count() == 0


@pytest.mark.parametrize("block", [2048, 50])
def test_pairs_on_one_template_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(9)
    some = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    template, rows = some(172), []
    for k in range(150):  # likeness 0.75 to all others, 0.80 to 0.85 to the partner
        own = rng.randint(17, 21)
        shared = some(28 - own)
        rows += [(2 * k, f"{template} {shared} {some(own)}"), (2 * k + 1, f"{template} {shared} {some(own)}")]
    got = near.groups(frame(spark, rows))
    want = brute.near(rows)
    assert len({r[2] for r in want}) == 150
    assert found(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=str)


# 10


def parse_count(text: str, learned: str) -> int:
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in learned:
            k += 1
        n, i = n + 1, i + k
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(4)
    learned = ["".join(rng.choice("abc ") for _ in range(150)) for _ in range(3)]
    model = language.Model({"x": learned, "y": ["zzz zq" * 30]})
    joined = "\0".join("".join(map(chr, model.squeezed(t))) for t in learned)
    rows = ["".join(rng.choice("abcq ") for _ in range(n)) for n in (1, 30, 500, 1024)]
    coded = [model.squeezed(t) for t in rows]
    got = model.phrases(np.concatenate(coded), np.cumsum([0, *map(len, coded)]))
    assert got[0].tolist() == [parse_count("".join(map(chr, c)), joined) for c in coded]


def test_languages(spark, nothing):
    rng = random.Random(6)
    say = {"en": ["the", "and", "thing", "over"], "fr": ["été", "où", "maison", "très"], "de": ["über", "straße", "nicht", "und"]}
    rows = []
    for k in range(150):
        lang = ["en", "fr", "de"][k % 3]
        rows.append((k, " ".join(rng.choice(say[lang]) for _ in range(60)), lang))
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !?", "fr"), (1003, "straße " * 5000, None), (None, "the thing", "en")]
    table = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, text string, lang string, score string")
    learned = language.sample(table, ~language.held_out())
    assert set(learned) == {"en", "fr", "de"} and all(len(v) <= language.SAMPLE for v in learned.values())
    got = {r["doc_id"]: r for r in language.predict(table, learned).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows)
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "de", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.predict(nothing, language.sample(nothing, ~language.held_out())).count() == 0


def test_languages_of_long_texts_only_are_learned(spark):
    rows = [(k, "the cat and the dog " * 20, "en") for k in range(20)] + [(100 + k, "le chat et le chien " * 300, "fr") for k in range(20)]
    table = spark.createDataFrame(rows + [(200, "the cow " * 900, "en")], "doc_id long, text string, lang string")
    learned = language.sample(table, F.lit(True))
    assert set(learned) == {"en", "fr"} and len(learned["fr"]) == 20
    assert all(len(t) <= language.LONGEST for t in learned["en"])


def test_blobs():
    arrays = [np.arange(5, dtype=np.uint64), np.zeros(0, np.int32), np.array([-1, 2], np.int64)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, R.unpack(R.pack(*arrays))))


def test_shards_of_sorted_keys():
    rng = np.random.default_rng(3)
    for bits, shards in ((48, 1), (48, 7), (32, 1000), (48, 50_000_000)):
        keys = np.unique(rng.integers(0, 1 << bits, 5000, np.uint64))
        dealt = R.Shards(keys, bits, shards)
        assert len(dealt.ids) <= len(keys) and [x for _, own in dealt for x in keys[own].tolist()] == keys.tolist()
        for shard, own in dealt:
            assert dealt.of(shard) == own and 0 <= shard < shards
            exact = {int(k) * shards >> bits for k in (int(keys[own.start]) >> (bits - 32) << (bits - 32),)}
            assert exact == {shard}
    assert not list(R.Shards(np.zeros(0, np.uint64), 48, 5))


def test_documents_without_id_are_spread(spark):
    rows = [(None, f"text {k} " * 2000) for k in range(1500)]
    chunks, _ = R.chunked(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes = [r["count"] for r in chunks.groupBy("chunk").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 0.8 * len(rows)


def test_classifier_learns_a_class_of_long_texts(spark):
    rng = random.Random(2)
    make = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, make(["fine", "prose", "reads", "well"], 200)) for k in range(40)] + [(100 + k, make(["junk", "spam", "click", "here"], 5000)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d < 100)) for d, _ in rows], "doc_id long, quality int")
    assert all(len(t) > quality.LONGEST for d, t in rows if d >= 100)
    model = quality.fit(docs, labels)
    assert model is not None
    p = {r["doc_id"]: r["p_quality"] for r in quality.judge(docs, model).collect()}
    assert min(p[k] for k in range(40)) > 0.5 > max(p[100 + k] for k in range(40))


def test_the_driver_does_not_train(spark, monkeypatch):
    make = lambda k, words: " ".join(f"{words[(7 * k + j * j) % len(words)]}{j % 9}" for j in range(60 + k))
    rows = [(k, make(k, ["fine", "prose", "reads"])) for k in range(30)] + [(100 + k, make(k, ["junk", "spam"])) for k in range(30)]
    labels = spark.createDataFrame([(d, int(d < 100)) for d, _ in rows], "doc_id long, quality int")
    order = sorted(rows, key=lambda r: (r[0] < 100, r[0] * 0x9E3779B97F4A7C15 % 2**64))
    want = quality.train([t for _, t in order], np.array([int(d < 100) for d, _ in order]))
    monkeypatch.setattr(quality, "train", None)  # tasks have the module of their own process
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert (model.weights == want.weights).all() and (model.slope, model.offset) == (want.slope, want.offset)


def test_training_holds_a_piece_of_the_text(monkeypatch):
    texts = [" ".join(f"{'good' if k % 2 else 'bad'}{j % 50}" for j in range(4000)) for k in range(60)]
    labels = np.arange(60) % 2
    monkeypatch.setattr(quality, "BITS", 12)
    monkeypatch.setattr(K, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    monkeypatch.setattr(K.pieces, "__defaults__", ("text", 1 << 16))
    tracemalloc.start()
    model = quality.train(texts, labels, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model is not None and peak < 10 * sum(map(len, texts))


def test_groups_without_crowds_are_not_compared_across(spark, monkeypatch):
    monkeypatch.setattr(near, "across", None)
    text = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join([*text[:k], f"x{k}", *text[k:]])) for k in range(4)] + [(10, "other words in this text"), (11, None)]
    got = near.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(brute.near(rows))


def test_groups_are_joined_by_their_edges(spark):
    frame_ = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names.split()))
    tops = frame_([(1, 1), (5, 1), (2, 2), (8, 2), (3, 3), (9, 3)], "node top")
    got = near.joined(tops, frame_([(2, 3), (4, 3), (7, 6)], "a b"))
    assert dict(map(tuple, got.collect())) == {1: 1, 5: 1, 2: 2, 8: 2, 3: 2, 9: 2, 4: 2, 6: 6, 7: 6}
    assert near.joined(tops, frame_([], "a b")) is tops


def test_revisits_of_one_id_and_long_bodies(spark):
    head = lambda tag: {"ETag": tag}
    body = "b" * 3_000_000
    rows = [
        (1, "http://a.com/x", 10, "response", head("1"), body), (1, "http://b.com/y", 20, "response", head("2"), "b"),
        (9, "http://a.com/x", 30, "revisit", head("1"), None), (9, "https://b.com:443/y", 40, "revisit", head("2"), None),
        (9, "http://a.com/x", 5, "revisit", head("1"), None), (9, "http://a.com/x", 30, "revisit", head("1"), None),
        (9, "http://b.com:443/y", 50, "revisit", head("2"), None), (1, "http://a.com/x", 10, "response", head("0"), "other"),
    ]
    records = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>, body string").repartition(4)
    got = [sorted((r["url"], r["ts"], r["refers_to"], r["status"], len(r["body"] or "")) for r in warc.resolve(records).collect()) for _ in range(2)]
    assert got[0] == got[1] and len(got[0]) == 5
    by = {x[:2]: x[2:] for x in got[0]}
    assert by["http://a.com/x", 5] == (None, "no_response", 0) and by["https://b.com:443/y", 40] == (1, "resolved", 1)
    # Not the default port of its scheme, so another resource.
    assert by["http://b.com:443/y", 50] == (None, "no_response", 0)
    assert by["http://a.com/x", 30] in {(1, "resolved", 3_000_000), (1, "changed", 0)}
