"""Decontamination, language ID, BPE, counts, secrets and chat against brute force and round trips."""

import hashlib
import pickle
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from routeloom.llm import bpe_chunks, chat, decontaminate, langid, secrets, token_counts, words
from routeloom.llm.common import word_bpe_path

SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def leaks_expected(rows, items, n=10):
    wins = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for k in range(max(1, len(w) - n + 1)) if w else []:
            wins.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = Counter()
    for doc, text, *_ in rows:
        w = WORD.findall(lower(text))
        hit, owners = set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (g := tuple(w[k : k + size])) in wins:
                    hit.update(range(k, k + size))
                    owners |= {str(i) for i in wins[g] if i is not None}
        out[doc, len(w), len(hit), len(owners), SHA(",".join(sorted(owners))), bool(hit)] += 1
    return out


@pytest.fixture(scope="module")
def items(corpus):
    texts = [r[1] for r in corpus if r[1] and len(r[1].split()) > 40][:4]
    return [(1, " ".join(texts[0].split()[5:30]).upper()), (2, texts[1][:200]), (10, "a, B; c-D!"), (3, ""), (4, None), (5, "?!"), (2, " ".join(texts[2].split()[:12])), (None, " ".join(texts[3].split()[3:15])), (6, "é ü ß 漢字 é ü ß 漢字 é ü ß 漢字 é")]


@pytest.mark.parametrize("block", [4 << 20, 150])
def test_decontaminate(spark, docs, corpus, items, block):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontaminate(docs.withColumn("n_hit", F.lit(3)), bench, block_bytes=block)
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert Counter(map(tuple, found.select(*cols).collect())) == leaks_expected(corpus, items)
    for r in found.where("n_hit > 0").collect():
        assert sum(len(WORD.findall(lower(r.text[s.start : s.end]))) for s in r.spans) == r.n_hit


@pytest.mark.parametrize("block", [4 << 20, 150])
def test_decontaminate_passes_clashing_columns_through(spark, docs, corpus, items, block):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontaminate(docs.withColumns({"_b": F.lit("x"), "_w": F.lit(1), "_I": F.lit(2)}), bench, block_bytes=block)
    assert {(r._b, r._w, r["_I"], r.body) for r in found.collect()} == {("x", 1, 2, "clash")}
    assert Counter(r.n_hit for r in found.collect()) == Counter(n for _, _, n, *_ in leaks_expected(corpus, items).elements())


def test_automaton_is_bounded_near_a_block():
    draw = random.Random(1)
    vocabulary = ["".join(draw.choice("abcdefghijklmnopqrst") for _ in range(6)) for _ in range(200_000)]
    items = [(str(k), " ".join(draw.choice(vocabulary) for _ in range(100)).encode()) for k in range(1500)]  # 1 MB
    code = (
        "import pickle, sys, resource; from routeloom.llm import decontaminate as d; items = pickle.load(sys.stdin.buffer);"
        "a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; w = d.Windows(items, 10);"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) // 1024, d.scan(items[7][1], w)[2])"
    )
    said = subprocess.run([sys.executable, "-c", code], input=pickle.dumps(items), capture_output=True, check=True, cwd=Path(decontaminate.__file__).parents[2]).stdout.decode().split()
    assert int(said[0]) < 200 and "'7'" in said[1], said


def test_columns_with_names_of_their_own_clash_with_none(spark):
    df = spark.createDataFrame([(1, "some words", "en")], "doc_id long, text string, lang string").withColumns({"_t": F.lit(5), "_T_": F.lit(6)})
    for found in (langid.identify(df, df), bpe_chunks.encode_decode(df), token_counts.count_tokens(df)):
        row = found.first()
        assert (row["_t"], row["_T_"], row.text) == (5, 6, "some words")


def profiles_expected(learned, asked, dims, n, unit=1 << 20):
    """The profiles written out a letter at a time."""
    letter = {}

    def of(c):
        if c not in letter:
            letter[c] = np.random.default_rng(7_919 + ord(c)).choice(np.array([-1, 1], np.int8), dims).astype(np.int64)
        return letter[c]

    def vector(text):
        runs = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not runs:
            return None
        line = " " + " ".join(runs) + " "
        out = np.zeros(dims)
        for k in range(len(line) - n + 1):
            bound = np.ones(dims, np.int64)
            for place, c in enumerate(reversed(line[k : k + n])):
                bound = bound * np.roll(of(c), place)
            out += bound
        return out

    total = {}
    for text, lang in learned:
        if lang is not None and (v := vector(text)) is not None:
            total[lang] = total.get(lang, 0) + np.rint(v.astype(np.float32) * (unit / float(np.sqrt(v @ v))))
    out = []
    for text in asked:
        v = vector(text)
        if v is None or not total:
            out.append(("und", 0.0))
            continue
        cosine = {lang: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for lang, p in total.items()}
        best = min(cosine, key=lambda x: (-cosine[x], x))
        out.append((best, max(0.0, min(1.0, cosine[best]))))
    return out


def test_profiles_against_brute_force(spark):
    draw = random.Random(4)
    made = lambda letters: " ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, 6))) for _ in range(draw.randint(1, 25))) + draw.choice(["", ". 12!", "\n--"])
    rows = [(k, made(letters), lang) for k, (letters, lang) in enumerate([("aeiouéxyz", "aa"), ("bcdaeßü", "bb"), ("漢字かなae", "cc")] * 25)] + [(90, None, "aa"), (91, "12 34", "bb"), (92, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, df.where("doc_id % 3 <> 1 OR doc_id > 60"), dims=256).collect()}
    expected = profiles_expected([(t, lang) for k, t, lang in rows if k % 3 != 1 or k > 60], [t for _, t, _ in rows], 256, 3)
    for (k, *_), (lang, score) in zip(rows, expected, strict=True):
        assert got[k][0] == lang and abs(got[k][1] - score) < 1e-5


def test_ledger_that_stays(spark, docs, corpus, tmp_path):
    path = str(tmp_path / "ledger")
    first = secrets.scan_incrementally(docs, path).select("doc_id", "blob", "findings").collect()
    size = spark.read.parquet(path).count()
    more = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(777).cast("long"), "text": F.lit("token = abcdef123456XYZ")}))
    second = secrets.scan_incrementally(more, path).select("doc_id", "blob", "findings").collect()
    assert spark.read.parquet(path).count() == size + 1 == len({r.blob for r in second})
    assert Counter(map(str, first)) == Counter(map(str, second)) - Counter(str(r) for r in second if r.doc_id == 777)


def test_copies_of_a_blob_collapse_before_the_shuffle(spark, docs):
    versions = docs.select(secrets.blob_of().alias("blob"), F.coalesce("text", F.lit("")).alias("body"))
    plan = versions.groupBy("blob").agg(F.first("body").alias("body"))._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("partial_first") > plan.rindex("Exchange hashpartitioning(blob")


def test_decontaminate_empty(spark, none, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(none, bench).collect() == []
    assert decontaminate.decontaminate(docs, bench).where("n_hit > 0 OR n_items > 0 OR contaminated").count() == 0


LANGS = {"xx": "abcde ", "yy": "fghij ", "zz": "éüßäö "}


def test_language_id(spark, docs, none):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        lang = rng.choice(list(LANGS))
        rows.append((k, "".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(20, 200))), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    said = langid.identify(df.drop("lang"), df.where("doc_id < 200")).join(df.select("doc_id", "lang"), "doc_id").where("doc_id >= 200").collect()
    assert np.mean([r.lang == r.lang_pred for r in said]) > 0.97
    assert all(0 <= r.score <= 1 for r in said)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 -- 3"), (4, "a"), (5, "ab " * 20000)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(odd, df).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[5].lang_pred == "xx" and got[4].lang_pred in LANGS
    assert {r.lang_pred for r in langid.identify(df.drop("lang"), df.limit(0)).collect()} == {"und"}
    assert langid.identify(none, df).collect() == [] and langid.identify(docs, df).count() == docs.count()


def test_language_model_is_the_same_for_any_layout(spark):
    df = spark.createDataFrame([(k, "abc cba " * (k + 1), "xx") for k in range(30)], "doc_id long, text string, lang string")
    a, b = langid.learn(df.repartition(1)), langid.learn(df.repartition(7))
    assert a.keys() == b.keys() and all((a[k] == b[k]).all() for k in a)


def test_remainder(spark):
    import zlib

    got = spark.createDataFrame([(k,) for k in [0, 1, 2, 17, 256409]] + [(None,)], "doc_id long").select("doc_id", langid.remainder().alias("r")).collect()
    assert [r.r for r in got] == [zlib.crc32(str(k.doc_id).encode()) % 4 if k.doc_id is not None else -1 for k in got]


def odd_texts():
    rng = random.Random(1)
    letters = " \t\nabcABC'sl ldre<|endoftext|>éÉßŞıİΣσςñ́̀ 漢字😀123½²ͅ\x00\x1c\x85…—"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    some = ["".join(rng.choice("abcdehilnorst") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    texts += [" ".join(rng.choice(some) for _ in range(rng.randint(100, 1500))) for _ in range(40)]
    return [*texts, texts[-1], texts[-1] + " x", "<|endoftext|>a<|startoftext|>" * 300, "x" * 5000, "", "aaaa aaa" * 500, "a" * 2000 + " " + "b" * 3000 + "<|endoftext|>" * 200, "'S'T it's"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_bpe_path())


def test_chunked_encoding_is_exact(library):
    texts = odd_texts()
    enc = bpe_chunks.Encoder(word_bpe_path())
    got = enc.encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert enc.reused > 10


def test_chunks_follow_the_content():
    data = np.random.default_rng(0).integers(97, 123, 30_000, dtype=np.uint8)
    a = bpe_chunks.cuts(data)
    b = bpe_chunks.cuts(np.concatenate([data[:100], data]))
    assert len(set(a) & {x - 100 for x in b}) > len(a) * 0.8 and a[-1] == len(data)


def test_encode_decode(docs, corpus, none, library):
    rows = bpe_chunks.encode_decode(docs, keep=["doc_id"], outputs=("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")).collect()
    expected = Counter()
    for doc, text, *_ in corpus:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected[doc, len(ids), tuple(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), library.decode(ids, skip_special_tokens=False), SHA(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.ids_sha256, r.decoded, r.decoded_sha256) for r in rows) == expected
    assert bpe_chunks.encode_decode(none).collect() == []


def test_token_counts(docs, corpus, none, library):
    texts = odd_texts()
    assert token_counts.Counter(word_bpe_path()).count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = Counter(map(tuple, token_counts.count_tokens(docs, keep=["doc_id"]).collect()))
    expected = Counter()
    for doc, text, *_ in corpus:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected[doc, len((text or "").encode()), n, n > 2048] += 1
    assert got == expected and token_counts.count_tokens(none).collect() == []


ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets_expected(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def secret_rows():
    rng = random.Random(3)
    bits = ["password", "Token", "API_KEY", "apikey", "secret", ": ", "=", '"', "'", " ", "é漢😀", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef" * 3, "short", "a1b2c3d4e5f6g7", "\n", ":", "token=secret=abc", "AKIAAKIA"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += [None, "", "password: token: abcdefghijklmnop", "password=" + "x" * 5000, ("secret = abcdef123456; " * 300), texts[0], texts[1]]
    return [(k, t) for k, t in enumerate(texts)] + [(5, "AKIA" + "Z" * 20), (None, "token=0123456789abcdef")]


def test_secrets(spark, none):
    rows = secret_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"blob": F.lit("clash"), "findings": F.lit(1), "path": F.lit("p")})
    found, added = secrets.scan(df)
    got = Counter()
    for r in secrets.digest(found).collect():
        got[tuple(r)] += 1
    expected = Counter()
    for doc, text in rows:
        s = secrets_expected(text or "")
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        kinds = Counter(k for *_, k in s)
        expected[doc, kinds["assign"], kinds["access"], kinds["hex"], SHA(said), said] += 1
    assert got == expected
    assert added.count() == len({t or "" for _, t in rows})
    assert secrets.scan(none)[0].collect() == []


def test_ledger_scans_only_what_is_new(spark):
    first = spark.createDataFrame([(1, "token=abcdef0123456789"), (2, "nothing")], "doc_id long, text string")
    _, ledger = secrets.scan(first)
    second = spark.createDataFrame([(1, "token=abcdef0123456789"), (1, "AKIA" + "X" * 16), (3, "nothing"), (4, "token=abcdef0123456789")], "doc_id long, text string")
    found, added = secrets.scan(second, ledger)
    assert added.count() == 1
    assert Counter((r.doc_id, len(r.findings)) for r in found.collect()) == Counter([(1, 2), (1, 1), (3, 0), (4, 2)])
    _, again = secrets.scan(second, ledger.unionByName(added), rule_version=2)
    assert again.count() == 3 and secrets.scan(second, ledger.unionByName(added))[1].count() == 0


def test_redact(spark):
    df = spark.createDataFrame([(1, "é token=abcdef0123456789ab end"), (2, "ok"), (3, "AKIA" + "X" * 16)], "doc_id long, text string")
    found, _ = secrets.scan(df, keep=("doc_id", "text"))
    got = dict(found.select("doc_id", secrets.redact(F.col("text"), F.col("findings"))).collect())
    assert got == {1: "é [assign] end", 2: "ok", 3: "[access]"}


def conversations():
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<<s>", "<</SYS>>", "[ROLE]x[/ROLE]y[END]", "", "é\n漢😀", "[INST", "/INST]", "\\[INST]", "<", "a" * 5000]
    rng = random.Random(6)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 8)):
            rows.append((conv, turn, ["user", "assistant"][turn % 2] if conv % 5 else rng.choice(["user", "assistant", "system", "tool", "[INST]", None]), rng.choice([*nasty, None])))
    rows += [(-1, 0, "user", nasty[0]), (-1, 1, "assistant", nasty[0]), (None, 1, "user", "x"), (None, 0, "assistant", "y"), rows[0], rows[0], (70, None, "user", "first"), (70, 3, "assistant", "then")]
    return rows


def test_chat(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit("c"), "loss": F.lit(2)}).repartition(4)
    segments = chat.format_chat(df)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    assert got.keys() == by.keys()
    for conv, turns in by.items():
        turns.sort()
        said = [t for _, _, r, t in turns if r == "assistant"]
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), sum(map(len, said)))
        assert r.turns_sha256 == SHA("".join(f"{a}\n{b}\n" for _, _, a, b in turns)) and r.loss_sha256 == SHA("".join(said))
        state, valid = None, True
        for _, _, role, _ in turns:
            valid &= role in chat.Template().follows.get(state, ())
            state = role
        assert r.valid == valid
        formatted = "".join(x.text for x in segments.where(F.col("conv_id").eqNullSafe(F.lit(conv))).orderBy("seq").collect()) if conv in (0, -1, None) else None
        assert formatted is None or len(formatted) == r.formatted_chars
    assert chat.read_back(chat.format_chat(df.limit(0))).collect() == []


def test_templates_must_be_readable():
    with pytest.raises(ValueError):
        chat.Template(turns={"user": ("<u>", "<u>x")})
    with pytest.raises(ValueError):
        chat.Template(turns={"user": ("\\u", "/u")})
    other = chat.Template(turns={"assistant": ("{{", "}}")}, general=("((", "||", "))"))
    machine, reader = chat.Machine(other), chat.Reader(other)
    turns = [("user", "a {{ b }} \\"), ("assistant", "}} (( ||")]
    read = [t for turn in turns for s, _ in machine.turn(*turn) for t in reader.feed(s)]
    assert read == turns
    with pytest.raises(ValueError):
        chat.Reader(other).feed("loose text")


def test_word_fingerprints():
    texts = [b"", b" a b ", "é ab c\n".encode(), b"x" * (words.BLOCK + 10) + b" y", b"a b"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    starts, ends, at = words.bounds(data, offsets, words.PLAIN)
    found = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert found == [w for t in texts for w in t.split()]
    assert np.diff(at).tolist() == [len(t.split()) for t in texts]
    h = words.hashes(data, starts, ends)
    assert len(set(h.tolist())) == len(set(found)) and len({(f, int(x)) for f, x in zip(found, h, strict=True)}) == len(set(found))


def test_texts_that_are_not_utf8(spark):
    """Bytes outside UTF-8 stop no operator; where text is decoded, they read as U+FFFD."""
    from routeloom.llm import fm_dedup, minhash, suffix_dedup

    odd = F.expr("CAST(X'61FF62206320FE' AS STRING)")
    df = spark.range(3).select(F.col("id").alias("doc_id"), odd.alias("text"), F.lit("xx").alias("lang"))
    bench = df.select(F.col("doc_id").alias("item_id"), "text")
    assert decontaminate.decontaminate(df, bench).where("contaminated").count() == 3
    assert langid.identify(df, df).where("lang_pred = 'xx'").count() == 3
    assert [r.n_bytes for r in token_counts.count_tokens(df).collect()] == [7] * 3
    assert len({r.n_tokens for r in token_counts.count_tokens(df).collect()} | {r.n_tokens for r in bpe_chunks.encode_decode(df, outputs=("n_tokens",)).collect()}) == 1
    assert secrets.digest(secrets.scan(df)[0]).count() == 3
    assert {r.component_id for r in minhash.near_duplicates(df).collect()} == {0}
    assert {r.n_removed for r in suffix_dedup.remove_repeats(df, 3, "none").collect()} == {7}
    assert sum(r.n_removed for r in fm_dedup.remove_repeats(df, 2).collect()) == 6
    turns = df.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text")
    assert chat.read_back(chat.format_chat(turns)).where("n_turns = 1").count() == 3
