"""Language model, language, quality, personal data and tokens, each against a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from wiretide.llm import language_id, lm_scoring, pii, quality_rules, sentencepieces, tokens

SPACE = r"[^\x20\x09-\x0D]+"


def test_lm_base_scores_and_gain(docs):
    got = {r["doc_id"]: r for r in lm_scoring.score(docs).collect()}
    rows = [(r["doc_id"], lm_scoring.words_of(r["text"]), zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in docs.collect()]
    c = Counter(w for _, ws, held in rows if not held for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    for i, ws, held in rows:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*ws, None]), abs_tol=1e-6)
        assert r["score"] < 0


def test_lm_beats_word_counts(spark):
    for sf in ("0.01", "0.1"):
        held = lm_scoring.score(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")).where("held_out").collect()
        assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)
        assert sum(r["score"] > r["base_score"] for r in held) >= 0.8 * len(held)


def suffix_tree(rows, depth, least, gain, discount):
    """The model by dictionaries: log10 probability of each text, and the number of retained contexts."""
    end = None
    texts = [(ws, held) for _, ws, held in rows]
    grams = Counter()
    for ws, held in texts:
        if not held:
            seq = [end, *ws, end]
            grams.update(tuple(seq[i - k : i + 1]) for i in range(1, len(seq)) for k in range(depth + 1) if i >= k)
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)

    def share(g):
        return grams[g] / (n if len(g) == 1 else sum(c for x, c in follow[g[:-1]]))

    follow = {}
    for g, c in grams.items():
        follow.setdefault(g[:-1], []).append((g, c))
    count = lambda s: sum(c for _, c in follow[s])
    kept = {s for s in follow if s and count(s) >= least * len(s) and sum(c * math.log(share(g) / share(g[1:])) for g, c in follow[s]) >= gain * len(follow[s])}

    def p(s, w):
        if not s:
            return (grams[(w,)] + 1) / (n + v + 1)
        if s not in kept:
            return p(s[1:], w)
        return max(grams[(*s, w)] - discount, 0) / count(s) + discount * len(follow[s]) / count(s) * p(s[1:], w)

    out = []
    for ws, _ in texts:
        seq = [end, *ws, end]
        out.append(sum(math.log10(p(tuple(seq[max(0, i - depth) : i]), seq[i])) for i in range(1, len(seq))))
    return out, len(kept), p, grams


def test_lm_is_the_suffix_tree(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", 150)  # several blocks and buckets
    monkeypatch.setattr(lm_scoring, "KEYS_PER_BUCKET", 200)
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(900)]
    texts = [" ".join(words[a : a + rng.randrange(0, 40)]) for a in (rng.randrange(880) for _ in range(90))] + ["", "New  words\tonly", "w1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = [(i, lm_scoring.words_of(t), zlib.crc32(str(i).encode()) % 7 == 2) for i, t in enumerate(texts)]
    for depth, least in ((2, 2), (3, 1), (1, 3)):
        want, kept, p, grams = suffix_tree(rows, depth, least, 1.0, 0.75)
        got = {r["doc_id"]: r for r in lm_scoring.score(df, depth=depth, least=least).collect()}
        assert all(math.isclose(got[i]["score"], w, abs_tol=1e-6) for i, w in enumerate(want))
        assert {r["tree_contexts"] for r in got.values()} == {kept}
        # Each state's distribution sums to one, with the share of all words never learned.
        for s in ((), (None,), (b"w1",), (b"w1", b"w2")):
            known = [g[0] for g in grams if len(g) == 1]
            assert math.isclose(sum(p(s, w) for w in known) + p(s, b"?"), 1) or s


def test_lm_awkward_rows(odd, none):
    got = lm_scoring.score(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert [r["n_tokens"] for r in got if r["doc_id"] == 0] == [1]
    assert lm_scoring.score(none).count() == 0


def test_language(docs, odd, none):
    rows = language_id.identify(docs).join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    assert all((got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True) for i in (0, 1, 2)) and got[5]["lang_pred"] == "en"
    assert language_id.identify(none).count() == 0
    assert {r["held_out"] for r in language_id.identify(odd).where("doc_id IS NULL").collect()} == {False}
    assert language_id.keep_identified(docs).count() >= 0.99 * docs.count()


def test_language_rejects_what_it_has_not_learned(spark):
    rng = random.Random(5)
    alphabets = {"cyrillic": range(0x430, 0x450), "han": range(0x4E00, 0x5A00), "greek": range(0x3B1, 0x3C9), "latin": range(97, 123)}
    italian = "il gatto dorme sulla sedia mentre la pioggia cade lentamente fuori dalla finestra e nessuno sembra accorgersi che il giorno sta per finire perché tutti guardano il fuoco nella stanza più grande della vecchia casa dove gli uomini parlano ancora delle loro storie".split()
    texts = [" ".join("".join(chr(rng.choice(a)) for _ in range(rng.randint(2, 9))) for _ in range(n)) for a in alphabets.values() for n in (20, 100, 2000)]
    texts += [" ".join(rng.choice(italian) for _ in range(n)) for n in (20, 100, 2000)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    foreign = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(texts)], docs.schema)
    rows = language_id.identify(docs.union(foreign)).join(docs.union(foreign), "doc_id").collect()
    assert [r["text"][:40] for r in rows if r["doc_id"] < 0 and not r["rejected"]] == []
    long = [r for r in rows if r["doc_id"] >= 0 and len(r["text"].split()) >= 20]
    assert sum(r["rejected"] for r in long) <= 0.01 * len(long)
    assert not [r for r in language_id.keep_identified(docs.union(foreign)).collect() if r["doc_id"] < 0]


def quality_brute(t):
    w = re.findall(SPACE, t or "")
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(SPACE, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, odd, none, spark):
    extra = spark.createDataFrame([(900, "a b c d e f g h i " * 9, "en"), (901, "\n".join(["same line here"] * 9 + ["", " "]), "en"), (902, "x " * 30, None)], "doc_id long, text string, lang string")
    for df in (docs, odd, extra):
        texts = [(str(r["doc_id"]), r["text"]) for r in df.collect()]
        want = sorted((i, *quality_brute(t)) for i, t in texts)
        got = quality_rules.quality(df).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
        assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    assert quality_rules.quality(none).count() == 0


def test_quality_keeps_other_languages(docs, spark):
    rng = random.Random(7)
    italian = "il di che la e non un per in una sono mi ho lo ma ha cosa con le ti gatto sedia pioggia finestra giorno fuoco stanza casa uomini storie parlano cadono lentamente dormono".split()
    russian = "и в не на я быть он с что а по это она этот к но они мы весь который кошка стул дождь окно день огонь комната дом люди рассказы говорят медленно".split()
    made = [(k, " ".join(rng.choices(ws, [20 - min(i, 19) for i in range(len(ws))], k=300)) + ".") for k, ws in (("it", italian), ("ru", russian)) for _ in range(60)]
    made += [("pt", " ".join(rng.choices(italian, k=300))), ("bg", " ".join(rng.choices(russian, k=300))), (None, " ".join(rng.choices(russian, k=300)))]
    made += [("it", " ".join(rng.choices(["parola", "vuota", "tavolo", "mare", "albero", "x"], k=300))), ("bg", " ".join(w + " |" for w in rng.choices(russian, k=300)))]
    rows = spark.createDataFrame([(-1 - i, t, k) for i, (k, t) in enumerate(made)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality(docs.select("doc_id", "text", "lang").union(rows)).collect()}
    assert [k for i, (k, _) in enumerate(made[:-2]) if not got[-1 - i]] == []
    assert not got[-len(made)] and not got[1 - len(made)]


def test_quality_distance(spark):
    refs = [[0.5, 0.5, 0.0], [0.1, 0.1, 0.8]]
    df = spark.createDataFrame([([3.0, 1.0, 0.0],), ([0.0, 0.0, 0.0],)], "h array<double>")

    def js(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
        return math.sqrt((kl(p) + kl(q)) / 2)

    got = [r[0] for r in df.select(quality_rules.js_distance("h", refs)).collect()]
    assert math.isclose(got[0], min(js([0.75, 0.25, 0], q) for q in refs)) and got[1] == 0


def test_quality_keeps_good_and_rejects_junk(docs, sf_dir, spark):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = [r for r in quality_rules.quality(docs).join(labels, "doc_id").collect() if not r["base_failed"]]
    good = [r["kept"] for r in rows if r["quality"] == 1]
    assert sum(good) >= 0.99 * len(good)
    assert quality_rules.keep_quality(docs).columns == docs.columns


def test_quality_rejects_labelled_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = [r for r in quality_rules.quality(docs).join(labels, "doc_id").collect() if not r["base_failed"]]
    kept = {q: [r["kept"] for r in rows if r["quality"] == q] for q in (0, 1)}
    assert sum(kept[0]) <= 0.05 * len(kept[0]) and sum(kept[1]) >= 0.99 * len(kept[1])


def luhn(d):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def pii_brute(t):
    out, digits = [], lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        if 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group())):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii(docs, odd, none, spark):
    extra = ["a@b.c%x@d.e @x a@@b.co", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (843) 555-7672 170.106.47.218", "1 " * 15000, "éà +33 6 12 34 56 78 😀 a.b@c.de", "+1 2", "9" * 20000]
    texts = spark.createDataFrame([(800 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    for df in (docs, odd, texts):
        want = {}
        for r in df.collect():
            b = pii_brute(r["text"] or "")
            listing = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b)
            want[r["doc_id"]] = (hashlib.sha256(listing.encode()).hexdigest(), [sum(x[1] == k for x in b) for k in range(4)], set(listing.split(",")) - {""})
        for r in pii.digest(pii.detect(df)).collect():
            sha, counts, base = want[r["doc_id"]]
            assert r["base_sha256"] == sha and [r[f"n_{k}"] for k in pii.BASE] == counts and base <= set(r["spans"].split(","))
    assert pii.digest(pii.detect(none)).count() == 0


def test_pii_adds_and_redacts(spark):
    rows = [(i, f'note token = "{hashlib.sha1(str(i).encode()).hexdigest()}" then +1 (843) 555-{7000 + i} 170.106.47.{i} mail m{i}@x.com ok') for i in range(40)] + [(90, "plain words only, 12 of them")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(pii.detect(df)).collect()}
    assert all("secret:" in spans[i] and "phone:" in spans[i] for i in range(40)) and spans[90] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[3] == 'note token = "<SECRET>" then <PHONE> <IP> mail <EMAIL> ok' and clean[90] == rows[-1][1]


def test_pii_reliabilities_decide_against_the_majority():
    """Labelers 0 and 1 are right, the other three fire at random: three of five votes must not do."""
    rng = random.Random(4)
    counts: Counter = Counter()
    truth: dict = {}
    for _ in range(6000):
        y = rng.random() < 0.4
        v = sum((rng.random() < p) << i for i, p in enumerate([0.97 if y else 0.02, 0.95 if y else 0.03, 0.5, 0.5, 0.5]))
        counts[v] += 1
        truth.setdefault(v, []).append(y)
    post = pii.posteriors([("email", v, c) for v, c in counts.items()])
    right = lambda rule: sum(t == rule(v) for v, ts in truth.items() for t in ts)

    def best(v):  # knows the true rates
        odds = 0.4 / 0.6
        for i, (p1, p0) in enumerate([(0.97, 0.02), (0.95, 0.03)]):
            odds *= p1 / p0 if v >> i & 1 else (1 - p1) / (1 - p0)
        return odds >= 1

    assert right(lambda v: post["email", v] >= 0.5) >= 0.99 * right(best) > 0.95 * 6000 > right(lambda v: bin(v).count("1") >= 3)
    assert post["email", 0b11100] < 0.5 < post["email", 0b00011]


def test_pii_classifier_sees_the_span():
    """Of equal votes, a span of the length and digits of the corpus's clear cases has the greater chance."""
    table = [("secret", 0b11111, 2, 2, 500), ("secret", 0, 0, 0, 500), ("secret", 0b00011, 2, 2, 40), ("secret", 0b00011, 0, 0, 40)]
    w = pii.fit(table)
    assert pii.chance(w, "secret", 0b00011, 2, 2) > 1.5 * pii.chance(w, "secret", 0b00011, 0, 0)


def test_pii_overlaps(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = []
    for i in range(40):
        spans = {(s := rng.randrange(3000), rng.randrange(5), s + rng.randrange(1, 30), rng.random() < 0.3) for _ in range(rng.choice([0, 3, 40, 700]))}
        rows.append((i, sorted(spans)))
    df = spark.createDataFrame(rows, f"doc_id long, all array<{pii.SPAN}>")
    for r in pii.settle(df, ["doc_id"]).collect():
        spans = rows[r["doc_id"]][1]
        base = [s for s in spans if s[3]]
        kept = list(base)
        for s in spans:
            if not s[3] and all(s[2] <= k[0] or k[2] <= s[0] for k in kept):
                kept.append(s)
        assert [tuple(x) for x in r["spans"]] == [s[:3] for s in sorted(kept)] and [tuple(x) for x in r["base"]] == [s[:3] for s in base]
    assert df.select(F.size("all")).count() == 40


def test_pii_keeps_columns_of_any_name(spark):
    names = ["t", "c", "base", "spans", "row", "x", "all", "some", "clean", "m", "g", "z", "i", "s", "a b", "x.y"]
    df = spark.createDataFrame([(1, "mail a@b.co now", *range(len(names))), (2, None, *range(len(names)))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = pii.redact(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, "mail <EMAIL> now", *range(len(names))), (2, None, *range(len(names)))] or sorted(map(tuple, got.collect()))[1][1] in (None, "")


def test_tokens_of_sections(docs, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.public_files()[0])
    for df in (docs, odd.where("doc_id <> 5")):
        sums = Counter()
        for r in tokens.section_counts(df).collect():
            sums[r["doc_id"]] += r["n_tokens"]
        assert all(sums[r["doc_id"]] == len(t.encode(r["text"] or "", add_special_tokens=False).ids) for r in df.collect())
    assert tokens.section_counts(none).count() == 0


def test_tokens_cross_sections(spark):
    df = spark.createDataFrame([(1, "one\n\n\n\ntwo"), (2, "é\nb")], "doc_id long, text string")
    got = [(r["section"], r["start"], r["end"], r["n_tokens"], r["n_crossing"]) for r in tokens.section_counts(df).where("doc_id = 1").orderBy("section").collect()]
    assert [g[:3] for g in got] == [(0, 0, 4), (1, 4, 5), (2, 5, 6), (3, 6, 7), (4, 7, 10)] and sum(g[3] for g in got) == sum(r["n_tokens"] for r in tokens.section_counts(df, "most").where("doc_id = 1").collect())
    assert sum(g[4] for g in got) >= 1


def test_ids_agree_with_the_library():
    from tokenizers import Tokenizer

    files = tokens.public_files()
    enc, t = tokens.Encoder(*files), Tokenizer.from_file(files[0])
    for s in ["", " a  b ", "x<|endoftext|>y", "日本 語", "a" * 5000, "  \x85 \xa0", "don't 12 + 3\n\n\tx"]:
        assert enc.ids(s).tolist() == t.encode(s, add_special_tokens=False).ids


def test_sentencepieces(docs, odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.public_model())
    for df in (docs, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        ids = sentencepieces.encode(df).collect()
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        assert all(list(r["ids"]) == sp.encode(texts[r["doc_id"]]) for r in ids)
        back = {r["doc_id"]: r["text"] for r in sentencepieces.decode(sentencepieces.encode(df)).collect()}
        assert back == texts
    assert all(r["round_trip"] for r in sentencepieces.digests(docs).collect())
    assert sentencepieces.encode(none).count() == 0


def test_sentencepiece_oddities():
    import random

    import sentencepiece

    m, sp = sentencepieces.Model(sentencepieces.public_model()), sentencepiece.SentencePieceProcessor(model_file=sentencepieces.public_model())
    rng = random.Random(2)
    texts = ["a  b", " a", "a ", "x▁y", "<s> <0x41>", "\x00a", "ab" * 3000, "   ", *["".join(rng.choice("ab c▁\nthe日👩é ") for _ in range(rng.randrange(50))) for _ in range(300)]]
    assert [x.tolist() for x in sentencepieces.encode_texts(m, texts)] == [sp.encode(t) for t in texts]
