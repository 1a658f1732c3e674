"""Language ID against plain expectation-maximisation over dictionaries, run until nothing moves."""
import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from subsetlab.llm import langid
from tests.conftest import FOLDER


def plain_buckets(text):
    data = list(f" {text.lower()} ".encode("utf-8", "replace"))
    return Counter(((a | b << 8 | c << 16) * 2654435761 % 2 ** 32) >> 17 for a, b, c in zip(data, data[1:], data[2:]))


def plain_model(rows):
    counts = defaultdict(Counter)
    for text, lang in rows:
        counts[lang] += plain_buckets(text)
    return {lang: (n, sum(n.values()) + 0.5 * langid.BUCKETS) for lang, n in sorted(counts.items())}


def plain_fit(model, grams, langs, rounds=400):
    share = {lang: 1 / len(langs) for lang in langs}
    probability = {g: {lang: (model[lang][0][g] + 0.5) / model[lang][1] for lang in langs} for g in grams}
    total = sum(grams.values())
    for _ in range(rounds):
        new = dict.fromkeys(langs, 0.0)
        for g, n in grams.items():
            whole = sum(share[lang] * probability[g][lang] for lang in langs)
            for lang in langs:
                new[lang] += n * share[lang] * probability[g][lang] / whole / total
        share = new
    return share, sum(n * math.log(sum(share[lang] * probability[g][lang] for lang in langs)) for g, n in grams.items())


def plain_languages(model, text):
    """(main language, its share among all, set) by the penalised likelihood."""
    grams = plain_buckets(text)
    every, _ = plain_fit(model, grams, list(model))
    order = sorted(every, key=lambda lang: -every[lang])
    chosen = order[:1]
    kept, best = plain_fit(model, grams, chosen, 1)
    for more in order[1:]:
        grown, gain = plain_fit(model, grams, [*chosen, more])
        if gain - best <= langid.PENALTY * 0.5 * math.log(sum(grams.values())):
            break
        chosen, kept, best = [*chosen, more], grown, gain
    main = max(chosen, key=lambda lang: kept[lang])
    return main, every[main], set(chosen)


def test_mixtures_equal_plain_expectation_maximisation(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").collect()
    model = plain_model([(r["text"], r["lang"]) for r in known])
    learned = langid.learn(docs)
    assert learned[0] == list(model)
    short = sorted((r for r in known if 40 < len(r["text"]) < 1500), key=lambda r: r["doc_id"])
    by_lang = {lang: [r["text"] for r in short if r["lang"] == lang] for lang in model}
    singles = [text for texts in by_lang.values() for text in texts[:5]]
    names = list(model)
    mixed = [a + "\n" + b for x, y in zip(names, names[1:] + names[:1]) for a, b in zip(by_lang[x][:2], by_lang[y][:2])]
    texts = singles + mixed
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(table, learned).collect()}
    several = 0
    for at, text in enumerate(texts):
        main, score, chosen = plain_languages(model, text)
        assert got[at]["lang_pred"] == main and set(got[at]["langs"]) == chosen, (at, main, chosen, got[at])
        assert abs(got[at]["score"] - score) < 0.02
        several += len(chosen) > 1
    assert several >= len(mixed) / 2


def test_odd_texts_are_undetermined(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    learned = langid.learn(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (None, "the text")], "doc_id long, text string")
    rows = langid.predict(odd, learned).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"]} == {1: "und", 2: "und", 3: "und"}
    assert all(r["score"] == 0.0 for r in rows if r["doc_id"]) and len(rows) == 4
    assert langid.predict(odd, langid.learn(docs.limit(0))).where(F.col("lang_pred") != "und").isEmpty()
