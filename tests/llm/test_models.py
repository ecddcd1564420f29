"""Classifiers against held-out rows, chat formatting against a plain Python version."""

import hashlib
import random
import zlib

import numpy as np

from taskframe.llm import chat, language, toxicity
from taskframe.llm.features import Words

SCHEMA = "doc_id long, text string, lang string, score string, predicted string"


def test_words_are_hashed_by_content():
    import pyarrow as pa

    w = Words(pa.array(["The cat, the CAT", None, "cat the"]))
    assert w.doc.tolist() == [0, 0, 0, 0, 2, 2] and w.hash[0] == w.hash[2] == w.hash[5] and w.hash[1] == w.hash[3] == w.hash[4] and w.hash[0] != w.hash[1]
    h, at = w.grams(2)
    assert at.tolist() == [0, 1, 2, 4] and h[0] == h[2] and h[1] == h[3]
    assert w.grams(2, 1)[1].tolist() == [0, 1]


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(3)
    clean = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    bad = ["vile", "scorn", "spite", "filth"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = rng.choices(clean, k=rng.randint(1, 80)) + rng.choices(bad, k=2) * toxic
        rng.shuffle(words)
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else " ".join(words), "en", "x", "y"))
        if i != 8:
            labels.append((i, int(toxic)))
    rows += [(None, "vile scorn", "", "", ""), (5000, None, "", "", ""), (5001, "", "", "", ""), (5002, "!", "", "", ""), (5002, "word " * 50_000, "", "", "")]
    labels += [(0, 0), (9999, 1), (None, 1), (3, None), (4, 2)]
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, lab.filter("doc_id is null or doc_id < 700"))
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id is not None and 700 <= r.doc_id < 900]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.98
    assert [r.predicted for r in got if r.doc_id in (5000, 5001)] == [0, 0] and [r.predicted for r in got if r.doc_id is None] == [1]
    assert toxicity.score(df.limit(0), model).count() == 0
    nothing = toxicity.train(df, lab.limit(0))
    assert {r.predicted for r in toxicity.score(df, nothing).collect()} == {0}
    folds = {r.doc_id: r.f for r in df.select("doc_id", toxicity.crc_fold(df.doc_id, 4).alias("f")).collect()}
    assert folds[None] == 0 and all(folds[i] == zlib.crc32(str(i).encode()) % 4 for i in range(900))


def test_language_on_held_out_rows(spark):
    rng = random.Random(4)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["tsch", "ung", "ber"], "cc": ["éa", "oui", "ê"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randint(1, 30))), lang, "", "") for i, lang in enumerate(rng.choices(list(parts), k=300))]
    odd = [(1000, None, "aa", "", ""), (1001, "", "aa", "", ""), (1002, "123 !?", "bb", "", ""), (None, "tschung", None, "", ""), (1003, "tschung " * 40_000, None, "", "")]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    model = language.train(df.filter("doc_id < 150 or doc_id > 999"))
    got = language.predict(df, model).collect()
    assert len(got) == 305 and all(0 <= r.score <= 1 for r in got)
    truth = {r[0]: r[2] for r in rows}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.doc_id is not None and 150 <= r.doc_id < 300]) > 0.98
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id is None or r.doc_id >= 1000} == {1000: "und", 1001: "und", 1002: "und", None: "bb", 1003: "bb"}
    nothing = language.train(df.limit(0))
    assert {(r.lang_pred, r.score) for r in language.predict(df, nothing).collect()} == {("und", 0.0)}
    assert language.predict(df.limit(0), model).count() == 0


def test_naive_bayes_counts(spark):
    df = spark.createDataFrame([(1, "ab", "x", "", ""), (2, "ba", "y", "", "")], SCHEMA)
    model = language.train(df)
    assert model.langs == ["x", "y"] and np.allclose(np.exp(model.log_prob).sum(0), 1) and np.allclose(np.exp(model.log_prior), 0.5)


def said(turns):
    return "".join(f"{r}\n{t}\n" for r, t, _ in turns)


def test_chat_round_trip(spark):
    rng = random.Random(9)
    odd = ["", None, "a", "<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", r"<\|im_sep|>", r"<\\|x", "<|", "|>", "<|im_sep|>", "ünïcode 日本 😀", "line\nline\n", "\\", "<|nl|>", "$1 \\1", "long " * 20_000]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", None, "odd\nrole", "<|x|>"]), rng.choice(odd)) for c in [*range(40), None] for t in range(rng.randint(1, 9))]
    rows += [(77, None, "user", "first"), (77, 1, "b", "tie"), (77, 1, "a", "tie"), (77, 1, "a", "tie"), (78, 0, "user", "alone")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, n int")
    made = chat.format_conversations(df)
    back = {r.conv_id: r for r in chat.parse_conversations(made).collect()}
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or "", r == "assistant"))
    assert {c: [tuple(t) for t in r.turns] for c, r in back.items()} == want
    for r in made.collect():
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(want[r.conv_id], want[r.conv_id][1:]))
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>\n") == blocks
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert [__import__("re").sub(r"<\\(\\*)\|", r"<\1|", s) for s in spans] == [t for _, t, loss in want[r.conv_id] if loss]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_query(spark):
    got = {r.conv_id: r for r in chat.query(spark, "/root/testdata/sf0.001").collect()}
    probe = chat.PROBE
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(probe)
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest()
    assert got[-1].loss_sha256 == hashlib.sha256(probe.encode()).hexdigest()


def test_fit_is_the_scalar_method():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 40, rng.integers(0, 12))) for _ in range(80)]
    labels = np.array([int(3 in r) if rng.random() < 0.9 else 1 for r in rows])
    z, n = {}, {}

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        l1 = 0.0 if i == "bias" else toxicity.L1
        if abs(zi) <= l1:
            return 0.0
        return ((l1 if zi > 0 else -l1) - zi) / ((toxicity.BETA + ni**0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(toxicity.PASSES):
        for k in order.permutation(len(rows)):
            active = [*rows[k].tolist(), "bias"]
            w = {i: weight(i) for i in active}
            g = 1 / (1 + np.exp(-sum(w.values()))) - labels[k]
            for i in active:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got, bias = toxicity.fit(rows, labels)
    assert abs(bias - weight("bias")) < 1e-9 and (got != 0).sum() > 0
    assert all(abs(got[i] - weight(i)) < 1e-9 for i in range(40)) and not got[40:].any()


def test_predict_is_the_scalar_method(spark):
    texts = [("de", "der hund und die katze"), ("de", "das ist ein haus"), ("en", "the dog and the cat"), ("en", "this is a house"), ("en", "THE end"), ("fr", "le chien et le chat")]
    df = spark.createDataFrame([(i, t, lang, "", "") for i, (lang, t) in enumerate(texts)], SCHEMA)
    model = language.train(df)

    def grams(text):
        code = [ord(c) for c in text.lower()]
        for k in language.ORDERS:
            for i in range(len(code) - k + 1):
                h = k
                for c in code[i : i + k]:
                    h = (h ^ c) * 0x01000193 % 2**32
                    h ^= h >> 15
                yield h * 0x85EBCA6B % 2**32 >> 32 - language.BITS

    langs, counts, prior = sorted({x for x, _ in texts}), {}, {}
    for lang, t in texts:
        prior[lang] = prior.get(lang, 0) + 1
        for p in grams(t):
            counts[lang, p] = counts.get((lang, p), 0) + 1
    total = {x: sum(v for (y, _), v in counts.items() if y == x) + language.SMOOTHING * 2**language.BITS for x in langs}
    asked = ["the cat", "ein hund", "le chat", "x", "", "und die"]
    rows = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(asked)], SCHEMA)
    got = {r.doc_id: r for r in language.predict(rows, model).collect()}
    for i, t in enumerate(asked):
        if not t:
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        score = [np.log(prior[x] / len(texts)) + sum(np.log((counts.get((x, p), 0) + language.SMOOTHING) / total[x]) for p in grams(t)) for x in langs]
        best = int(np.argmax(score))
        assert got[i].lang_pred == langs[best] and abs(got[i].score - 1 / np.exp(np.array(score) - score[best]).sum()) < 1e-4


def test_three_hundred_languages(spark):
    rng, rows = random.Random(5), []
    for k in range(300):
        letters = [chr(0x4E00 + 7 * k + j) for j in range(7)]
        rows += [(10 * k + i, "".join(rng.choices(letters, k=40)), f"l{k:03d}", "", "") for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = language.train(df.filter("doc_id % 10 < 2"))
    got = {r.doc_id: r.lang_pred for r in language.predict(df, model).collect()}
    assert len(model.langs) == 300 and np.mean([got[i] == lang for i, _, lang, _, _ in rows if i % 10 == 2]) > 0.99


def test_long_conversations_and_spans_in_bytes(spark):
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["é<|x", "日本", "plain", ""]) * rng.randint(0, 3)) for t in range(1500)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = made.withColumn("said", chat.loss_texts(made)).collect()[0]
    want = [t for _, _, role, t in rows if role == "assistant"]
    raw = r.formatted.encode()
    assert r.said == want and [s.start for s in r.loss_spans] == [len(raw[: s.byte_start].decode()) for s in r.loss_spans]
    assert all(r.formatted[s.start : s.start + s.length].encode() == raw[s.byte_start : s.byte_start + s.byte_length] for s in r.loss_spans)
