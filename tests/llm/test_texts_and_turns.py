"""Byte pairs, repair of conversations and fill-in-the-middle, against plain versions."""

from __future__ import annotations

import hashlib
import json
import random
import re
from array import array
from collections import Counter

import brute
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from test_llm import frame, texts
from tidewatch.llm import bytepairs, dialogue, imatch, infill, queries


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def odd_texts() -> list[tuple[int | None, str | None]]:
    passage = "It isn't what we've seen: 3 of 10 (or 30%), they'll say. " * 40
    rows = texts()
    rows += [
        (200, "<|endoftext|>"), (201, "a<|endoftext|>b <|endoftext|> \n<|endoftext|>" * 60), (202, "don't  can 't \t\t x\n\n\n y'll'll"), (203, " " * 5000 + "x"),
        (204, "漢字仮名交じり文" * 3000), (205, "a" * 9000), (206, passage), (207, "Q " + passage), (208, "x" + passage + "'"), (209, "…" + passage[3:] + " \n"),
        (210, passage[:1500] + "<P>" + passage), (211, "\n\n\n"), (212, "\r\n one\r\ntwo\x0b \x85　three" * 50), (213, "l1\n" + "long " * 20_000 + "\nl3"), (214, passage + passage),
    ]
    return rows


# 11


def test_byte_pairs_are_the_librarys(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = odd_texts()
    got = bytepairs.digest(frame(spark, rows), path)
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_byte_pairs_there_and_back(spark):
    path = queries.tokenizer("byte_bpe_50k.json")
    rows = odd_texts()
    docs = frame(spark, rows).withColumn("place", F.lit("p")).withColumn("ids", F.lit("i"))
    back = bytepairs.decode(bytepairs.encode(docs, path), path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
    assert bytepairs.digest(docs.limit(0), path).count() == 0


def test_shared_chunks_are_encoded_once(spark):
    path = queries.tokenizer("byte_bpe_50k.json")
    rng = random.Random(3)
    passage = " ".join(rng.choice(["the", "tide", "turns", "at", "noon,", "they", "say."]) for _ in range(2000))
    docs = spark.createDataFrame([(k, f"{k} {passage} {k * k}") for k in range(40)], "doc_id long, text string").repartition(4)
    own = bytepairs.texts_of(docs)
    found = bytepairs.shared(own, path).collect()
    assert len(found) >= 5 and len({r["chunk"] for r in found}) == len(found)
    # Most places take their ids from a chunk that is encoded once for all forty documents.
    assert bytepairs.places(own).join(bytepairs.shared(own, path), "chunk").count() >= 40 * 5


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab'sl ,.\n\t1é漢<|>endoftx", max_size=300), st.lists(st.integers(0, 300), max_size=5))
def test_joins_are_repaired_wherever_a_text_is_cut(text, at):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    words, raw = bytepairs.vocabulary(path), text.encode()
    bounds = sorted({0, len(raw), *(bytepairs._whole(np.frombuffer(raw, np.uint8), min(a, len(raw))) for a in at)})
    chunks = {k: array(words.kind, words.ids(raw[a:b])).tobytes() for k, (a, b) in enumerate(zip(bounds, bounds[1:]))}
    made = bytepairs.joined(raw, np.array(bounds), chunks, words)
    assert made == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x260), max_size=200))
def test_quick_encoder_agrees(text):
    words, raw = bytepairs.vocabulary(queries.tokenizer("byte_bpe_50k.json")), text.encode()
    assert words.quick and words.ids(raw) == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_cuts_follow_the_content():
    rng = random.Random(1)
    body = bytes(rng.randrange(97, 123) for _ in range(50_000))
    a, b = (bytepairs.cuts(np.frombuffer(x, np.uint8)) for x in (body, b"shifted " + body))
    assert len(set(a.tolist()) & {x - 8 for x in b.tolist()}) > 0.8 * len(a)
    for data in (b"a" * 200_000, "漢".encode() * 70_000):
        c = bytepairs.cuts(np.frombuffer(data, np.uint8))
        assert c[0] == 0 and c[-1] == len(data) and max(np.diff(c)) <= bytepairs.MOST and all(data[x] & 0xC0 != 0x80 for x in c[:-1])


def test_other_tokenizers_are_refused(tmp_path):
    told = json.load(open(queries.tokenizer("byte_bpe_50k.json"), encoding="utf-8"))
    told["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(told))
    with pytest.raises(ValueError):
        bytepairs.Vocabulary(str(path))


# 12


def turns() -> list[tuple]:
    rng = random.Random(9)
    rows = []
    for conv in range(150):
        n = rng.choice([0, 1, 2, 3, 5, 8])
        for turn in range(n):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "Bot", "", None, "Person"])
            text = rng.choice(["Yes.", "No", " \n", "", "Why?\n ", "x! y", None, "same.", "same.", "é…", "z" * 5000 + "."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
        if n:
            rows.append(rows[-1])
    rows += [(None, 0, "user", "null key."), (None, None, "assistant", "x"), (None, 1, None, None), (-5, 2**40, "user", "far."), (-5, 0, "assistant", "near.")]
    return rows


def test_dialogue_repair(spark):
    rows = turns()
    docs = spark.createDataFrame([(*r, "c", 1, "f") for r in rows], "conv_id long, turn long, role string, text string, copy string, fault int, audit string").repartition(3)
    got = {r["conv_id"]: tuple(r) for r in dialogue.digest(dialogue.damage(docs)).collect()}
    want = {r[0]: r for r in brute.dialogues(rows)}
    assert got == want
    assert dialogue.digest(dialogue.damage(docs.limit(0))).count() == 0


def test_dialogue_repair_of_rows_as_they_are(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "system", "Be kind."), (2, 0, "system", "Only rules."), (3, 0, "user", " ")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in dialogue.digest(docs).collect()}
    for conv in (1, 2, 3):
        own = [(r[2], r[3]) for r in rows if r[0] == conv]
        faults = [brute.fault(x, own[:k]) for k, x in enumerate(own)]
        cost, audit, left = brute.cheapest(own, faults)
        assert (got[conv]["cost"], got[conv]["audit"], got[conv]["repaired_sha256"]) == (cost, audit, sha("\n".join(left)))
    made = [tuple(r) for r in dialogue.repaired(docs).orderBy("conv_id", "position").collect()]
    for conv in {r[0] for r in made}:
        assert re.fullmatch("(s?(ua)+)?", "".join(r[3][:1] for r in made if r[0] == conv))
        assert "\n".join(f"{r[3]}:{r[4]}" for r in made if r[0] == conv) == "\n".join(brute.cheapest(*[(o := [(x[2], x[3]) for x in rows if x[0] == conv]), [brute.fault(x, o[:k]) for k, x in enumerate(o)]])[2])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suaxx"), st.sampled_from([dialogue.SOUND, dialogue.SOUND, dialogue.BLANK, dialogue.DUPLICATE, dialogue.CUT])), max_size=12), st.integers(2, 5))
def test_audit_is_the_least_of_the_cheapest(rows, size):
    held, dialogue.BLOCK = dialogue.BLOCK, size
    try:
        parse = dialogue.Parse()
        for initial, fault in rows:
            parse.read(initial if initial != "x" else "", fault)
        cost, audit = parse.end()
    finally:
        dialogue.BLOCK = held
    names = {"s": "system", "u": "user", "a": "assistant", "x": "x"}
    assert (cost, audit) == brute.cheapest([(names[i], str(k)) for k, (i, _) in enumerate(rows)], [f for _, f in rows])[:2]


def test_long_conversation_parses_in_bounded_time():
    parse = dialogue.Parse()
    parse.read("u", dialogue.SOUND)
    for _ in range(60_000):  # no two tops agree on the first edit here, and none is dropped
        parse.read("u", dialogue.DUPLICATE)
    cost, audit = parse.end()
    assert len(audit) == 60_002 and audit[1:-1] == "D" * 60_000 and cost == 3 * 60_000 + 2


# 13


def fill(rows, seed=7, rate=100, first=50):
    out = []
    for doc_id, text in rows:
        text = text or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        n = len(units)
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
            out.append((doc_id, n, "plain", None, None, sha(text), sha(text)))
            continue
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "spm" if h4 % 100 < first else "psm"
        made = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
        out.append((doc_id, n, form, len(prefix), len(middle), sha(made), sha(text)))
    return out


@pytest.mark.parametrize("draws", [(7, 100, 50), (3, 60, 10)])
def test_fill_in_middle(spark, draws):
    rows = odd_texts()
    docs = frame(spark, rows).withColumn("place", F.lit("p")).withColumn("_row", F.lit("r")).withColumn("form", F.lit("f"))
    got = infill.digest(docs, infill.Draws(*draws))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(fill(rows, *draws), key=str)
    assert infill.digest(docs.limit(0)).count() == 0


def test_fill_in_middle_gives_texts(spark):
    rows = [(k, t) for k, (_, t) in enumerate(odd_texts())]
    parts = infill.transformed(frame(spark, rows)).orderBy("doc_id", "part").collect()
    texts_of = Counter()
    made: dict[int, str] = {}
    for r in parts:
        texts_of[r["doc_id"]] += 1
        made[r["doc_id"]] = made.get(r["doc_id"], "") + bytes(r["output"]).decode()
    assert {d: sha(t) for d, t in made.items()} == {r[0]: r[5] for r in fill(rows)}
    assert max(texts_of.values()) > 3


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<PSM> \né", max_size=60), st.integers(0, 50), st.integers(1, 9))
def test_dissection_does_not_depend_on_the_parts(text, doc_id, size):
    raw = text.encode()
    form, _, stretches = infill.cut(doc_id, raw, infill.Draws())
    made = b"".join(infill.MARKERS.get(s, b"") + raw[a:b] for s, a, b in stretches)
    found: dict[str, bytes] = {}
    for name, part in infill.dissect(form, (made[k : k + size] for k in range(0, len(made), size))):
        found[name] = found.get(name, b"") + part
    assert b"".join(found.get(s, b"") for s in infill.SOURCE) == raw


# 8


def test_fingerprints_against_a_plain_version(spark):
    rng = random.Random(8)
    common = [f"w{k}" for k in range(400)]
    rows = [(3 * k - 20, " ".join(rng.choice(common) + rng.choice(["", "", "É", "."]) for _ in range(rng.randint(5, 25)))) for k in range(120)]
    rows[7] = (rows[7][0], rows[6][1])
    rows[9] = (rows[9][0], rows[8][1].upper().replace("É", "é"))
    got = {r["doc_id"]: r for r in imatch.fingerprints(frame(spark, rows)).collect()}
    for d, n_chars, sha256, own, edit, near, after in brute.fingerprints(rows, imatch.DENSITIES, imatch.SUBSETS, imatch.RAREST, imatch.COMMONEST):
        r = got.pop(d)
        assert (r["n_chars"], r["edited_sha256"]) == (n_chars, sha256)
        if set(own) != set("-."):
            assert r["fingerprint"] == own and set(edit) == set("-.") or r["edited_fingerprint"] == edit
            assert r["near_edited"] == pytest.approx(near) and r["near_next"] == pytest.approx(after)
    assert not got
