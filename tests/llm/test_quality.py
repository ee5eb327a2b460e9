"""Quality rules (op8) against a brute-force version."""

import random
import re

import public_tokenizers as P
from pyspark.sql import functions as F

from docmill.llm import quality, queries
from odd_rows import texts  # noqa: F401 (fixtures)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def fertility(text, lang, model):
    import math
    from collections import Counter
    ids = [i for w in WORD.findall(text or "") for i in model.encode(w)]
    n = max(len(ids), 1)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
    share = min(1.0, entropy / min(math.log2(max(len(ids), 2)), 11.0))
    chars = sum(map(len, WORD.findall(text or "")))
    return chars / n, sum(model.is_byte(i) for i in ids) / n, share, entropy, len(ids)


def enough(bits, n_tokens, band):
    import math
    if "entropy_bits" not in band:
        return True
    c0, c1, c2, low, least, most = band["entropy_bits"]
    size = math.log2(max(n_tokens, 1))
    x = min(max(size, least), most)
    return bits >= c0 + c1 * x + c2 * x * x + low - max(0, least - size)


def check(rows, texts, all_bands=quality.BANDS):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in rows:
        text, lang = texts[r["doc_id"]]
        want = brute(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                r["base_failed"]) == want, r
        *measures, bits, n_tokens = fertility(text, lang, model)
        assert r["n_tokens"] == n_tokens and abs(r["entropy_bits"] - bits) < 1e-5
        assert all(abs(a - b) < 1e-5 for a, b in zip(
            measures, (r["chars_per_token"], r["byte_share"], r["entropy_share"]))), (r, measures)
        bands = all_bands.get(lang) or all_bands[r["script"]]
        inside = all(lo <= m <= hi for m, (lo, hi) in zip(
            measures, (bands["chars_per_token"], bands["byte_share"], bands["entropy_share"])))
        assert r["kept"] == (not want[-1] and inside and enough(bits, n_tokens, bands)), r


def test_op8_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = queries.op8_quality(spark, SF).collect()
    assert len(rows) == len(docs)
    bands = quality.fit_bands(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"),
                              P.path("piece_bpe_32k.model"))
    check(rows, {r["doc_id"]: (r["text"], r["lang"]) for r in docs}, bands)


def test_fitted_bands_decide(spark):
    """On held-out labels: what is labelled bad goes, what is labelled good stays."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = P.path("piece_bpe_32k.model")
    bands = quality.fit_bands(docs, labels.where(~held), model)
    assert {k for k in bands if bands[k] != quality.BANDS.get(k)} == {"en", "de", "fr", "es"}
    rows = quality.measure(docs.join(labels.where(held), "doc_id"), model, keep=["quality"], bands=bands) \
        .where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double"))).collect()
    share = {r[0]: r[1] for r in rows}
    assert share[1] >= 0.985 and share[0] <= 0.1


def test_fit_without_enough_labels(spark, texts):
    model = P.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(None, "x", None)],
                               "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(5)] * 3 + [(None, 1), (7, None)], "doc_id long, quality int")
    assert quality.fit_bands(df, labels, model) == quality.BANDS
    assert quality.fit_bands(df, labels.where("false"), model) == quality.BANDS
    assert quality.fit_bands(df.where("false"), labels, model) == quality.BANDS
    twice = df.unionByName(df.where("doc_id = 5")).where("doc_id in (5, 6)")
    assert quality.fit_bands(twice, labels.selectExpr("doc_id + 1 as doc_id", "quality"), model, least=1).keys() == quality.BANDS.keys()


def test_odd_rows(spark, texts):
    more = texts + ["a b c d e f g h " * 9, "Он не " * 30 + "пришёл " + " ".join(f"слово{i}" for i in range(60)),
                    "漢字 仮名 " + " ".join(f"語{i}" for i in range(40)), "###" * 40, "l one\nl one\n\n \n \nl one \nx"]
    langs = ["en", None, "xx", "de", "LATIN"]
    rows = [(i, t, langs[i % 5], "clash", 0.5) for i, t in enumerate(more)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, BYTE_SHARE double")
    out = quality.measure(df, P.path("piece_bpe_32k.model"))
    got = out.collect()
    assert len(got) == len(rows)
    check(got, {i: (t, lang if lang in quality.BANDS and lang.islower() else None) for i, t, lang, *_ in rows})
    kept = quality.keep_good(df, P.path("piece_bpe_32k.model"))
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"])
    assert quality.measure(df.where("false"), P.path("piece_bpe_32k.model")).count() == 0


def test_prose_is_kept_and_noise_rejected(spark):
    prose = " ".join(f"The {a} of the {b} was found near this place." for a, b in zip(
        "river house stone garden letter window teacher village market bridge".split(),
        "north king child summer morning doctor evening valley harbour forest".split()))
    noise = " ".join("".join(chr(0x2500 + (i * j) % 90) for j in range(1, 9)) + str(i) for i in range(60))
    df = spark.createDataFrame([(1, prose, "en"), (2, noise, "en")], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in quality.keep_good(df, P.path("piece_bpe_32k.model")).collect()] == [1]


SAMPLES = {
    "HAN": "昨天下午 我和朋友 去了河边的 一家小书店 店主是 一位退休的 老师 他向我们 介绍了许多 有关当地 历史的书籍 我们坐在 窗边喝茶 "
           "聊了很久 直到天黑 才回家 第二天 早晨又 下起了小雨 街上的人 很少",
    "HANGUL": "어제 오후에 나는 친구와 함께 강가에 있는 작은 서점에 갔다. 주인은 은퇴한 선생님이었고 우리에게 이 마을의 역사에 관한 많은 "
              "책을 소개해 주었다. 우리는 창가에 앉아 차를 마셨다.",
    "ARABIC": "ذهبت أمس بعد الظهر مع صديقي إلى مكتبة صغيرة بالقرب من النهر وكان صاحبها معلما متقاعدا حدثنا عن كتب كثيرة حول تاريخ المدينة",
    "GREEK": "Χθες το απόγευμα πήγα με έναν φίλο σε ένα μικρό βιβλιοπωλείο κοντά στο ποτάμι. Ο ιδιοκτήτης ήταν συνταξιούχος "
             "δάσκαλος και μας μίλησε για πολλά βιβλία σχετικά με την ιστορία της πόλης.",
    "DEVANAGARI": "कल दोपहर मैं अपने मित्र के साथ नदी के पास एक छोटी किताबों की दुकान पर गया। दुकान के मालिक एक सेवानिवृत्त शिक्षक थे और "
                  "उन्होंने हमें शहर के इतिहास के बारे में कई पुस्तकें दिखाईं।",
}


def test_noise_is_rejected_and_prose_kept_without_a_known_language(spark):
    draw = random.Random(2)

    def noise(a, b, stray=""):
        return " ".join("".join(chr(draw.randrange(a, b)) for _ in range(6)) for _ in range(60)) + stray

    bad = [noise(0x2500, 0x2580), noise(0x1F300, 0x1F640), noise(0x30, 0x3A), noise(0x4E00, 0x9FFF),
           noise(0xAC00, 0xD7A3), noise(0x3041, 0x3096), noise(0x1F300, 0x1F640, " ሰው ነው")]
    good = list(SAMPLES.values()) + ["ትናንት ከሰዓት በኋላ ከጓደኛዬ ጋር በወንዙ አጠገብ ወዳለው ትንሽ የመጽሐፍ መደብር ሄድኩ "
                                     "ባለቤቱ ጡረታ የወጣ መምህር ነበር እና ስለ ከተማው ታሪክ ነገረን"]
    rows = [(i, t, lang) for i, t in enumerate(good + bad) for lang in (None, "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = quality.measure(df, P.path("piece_bpe_32k.model")).collect()
    assert [r["script"] for r in out if r["lang"] is None][:len(SAMPLES)] == list(SAMPLES)
    assert [(r["doc_id"], r["base_failed"]) for r in out if r["kept"]] == [
        (i, False) for i in range(len(good)) for _ in range(2)]
    assert not any(r["base_failed"] for r in out)


def test_script_is_voted_by_every_letter():
    # a sample of every fourth character sees the Greek letters only
    assert quality.script_of("βабв".encode() * 400) == "CYRILLIC"
    draw = random.Random(3)
    for text in ["".join(draw.choice("aé жβ漢かカ한م1 .—") for _ in range(3000)) for _ in range(5)]:
        votes = {"LATIN": "aé", "CYRILLIC": "ж", "GREEK": "β", "HAN": "漢", "KANA": "かカ", "HANGUL": "한", "ARABIC": "م"}
        counts = {k: sum(map(text.count, v)) for k, v in votes.items()}
        assert quality.script_of(text.encode()) == max(counts, key=lambda k: (counts[k], k))
    assert [quality.script_of(x) for x in (None, b"", "12 — …".encode(), b"ab 12")] == ["NONE"] * 3 + ["LATIN"]


def test_bands_come_from_every_good_document(spark):
    """All labelled rows count, however many: the limits are numpy's on all of them."""
    import numpy as np
    draw = random.Random(8)
    words = "the a river stone house of garden and letter to window Teacher 12 village, market. bridge".split()
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(25, 160))), "en" if i % 3 else "de") for i in range(9000)]
    docs = spark.createDataFrame(rows + rows[:40], "doc_id long, text string, lang string").repartition(8)
    labels = spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(9000)], "doc_id long, quality int")
    model = P.path("piece_bpe_32k.model")
    bands = quality.fit_bands(docs, labels, model)
    got = quality.measure(docs.dropDuplicates(["doc_id"]), model).where("not base_failed and doc_id % 7 > 0").collect()
    assert len(got) > 7000
    for lang in ("en", "de"):
        chars, share, n, bits = np.array([(r.chars_per_token, r.byte_share, r.n_tokens, r.entropy_bits)
                                          for r in got if r.lang == lang]).T
        b = bands[lang]
        assert np.allclose(b["chars_per_token"], np.quantile(chars, [0.002, 0.998]) + [-1e-6, 1e-6], atol=1e-9)
        assert np.isclose(b["byte_share"][1], np.quantile(share, 0.998) + 1e-6, atol=1e-9)
        curve = np.polyfit(np.log2(n), bits, 2)
        assert np.allclose(b["entropy_bits"][:3], curve[::-1], atol=1e-5)
        over = bits - np.polyval(curve, np.log2(n))
        assert np.allclose(b["entropy_bits"][3:], [np.quantile(over, 0.002), np.log2(n.min()), np.log2(n.max())], atol=1e-4)
    measured = quality.measure(docs, model, keep=["doc_id", "lang"])
    assert quality.fit_bands(docs, labels, model, measured=measured) == bands


def test_a_worker_holds_little_at_once():
    """Peak of the kernel's own memory over a batch of 4 MB, beside what it remembers."""
    import tracemalloc

    import pyarrow as pa

    from docmill.llm.common import slices
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    body = pa.array([" ".join(rng.choices(words, k=700)).encode() for _ in range(1200)], pa.binary())
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        kernel = quality._kernel(f.read())
    kernel([" ".join(words).encode()])
    tracemalloc.start()
    for a, b in slices(body):
        kernel(body.slice(a, b - a).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


def test_long_words_are_measured_but_not_remembered():
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        made = quality.Fertility(f.read())
    long = [bytes([97 + i % 26]) * (100 + i) for i in range(50)]
    want = [made.model.encode(w.decode()) for w in long]
    for _ in range(2):
        assert [i.tolist() for i in made.ids([[b"short", w] for w in long])] == [
            made.model.encode("short") + w for w in want]
    assert set(made.known) == {b"short"}


def test_small_tables_need_no_python_workers(spark):
    from conftest import plan_text

    from docmill.llm.common import small_table
    rows = [("en", 1, 0.5), ("de", -2, 1.5)]
    made = small_table(spark, rows, "name string, b long, c double")
    assert made.dtypes == [("name", "string"), ("b", "bigint"), ("c", "double")]
    assert [tuple(r) for r in made.collect()] == rows and "LocalTableScan" in plan_text(made)
