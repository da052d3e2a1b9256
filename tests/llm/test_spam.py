import random

from lodestar.llm.spam import FUNCTION_WORDS, judge, language, measure, punctuation_limit, sentences, skeleton, spam_scores

WORDS = "agency council member report gift value official decision interest property income committee meeting contract source city county manager letter question analysis facts board term".split()


FORMS = (
    "The {} of the {} has an {} in this {} and may report it before day {}.", "Because no {} was found, we conclude that your {} is not a {} under rule {}.", "On day {4}, the {0} asked whether a {1} could be part of any {2}.",
    "If a {} is paid by its {}, then each {} should be listed in form {}.", "Although you were a {} at that time, there was neither {} nor {} after year {}.", "We have also looked into the {} which the {} kept for years, with {} boxes of {}.",
    "Your {0} does not differ from what another {1} described as their {2} in {4}.", "It would be for the {} to decide when a {} like this turns into the {} of {} people.", "Some {} had been given to those who signed the {}, but only {} were ever sent to {}.",
)


def prose(rng, n):
    return " ".join(rng.choice(FORMS).format(*[rng.choice(WORDS) + "aeiou"[rng.randrange(5)] * rng.randrange(2) for _ in range(3)], rng.randint(1, 9999), rng.randint(1, 9999)) for _ in range(n))


def test_kinds(spark):
    rng = random.Random(2)
    good = {f"prose{i}": prose(rng, 12) for i in range(40)}
    good |= {
        "links": prose(rng, 12) + "\n\nSee also:\nhttps://a.example/x", "agenda": "AGENDA\n" + "\n".join(f"{k}. Review the {rng.choice(WORDS)} of the {rng.choice(WORDS)}" for k in range(1, 15)) + "\n\n" + prose(rng, 4),
        "authorities": "Authorities cited\n" + "\n".join(f"Section {rng.randint(81000, 90000)} ..... {k}" for k in range(1, 40)) + "\n\n" + prose(rng, 2),
        "payments": "Payments received:\n" + "\n".join(f"{rng.randint(100, 999)}.{rng.randint(10, 99)}" for _ in range(40)) + "\n\n" + prose(rng, 3), "short": "gift gift gift", "blank": "  \n ", "empty": "", "null": None,
        "long": prose(rng, 8000),
    }
    bad = {
        "keywords": ", ".join(rng.choice(("ethics attorney", "attorney near me")) for _ in range(150)), "urls": "\n".join(f"http://{rng.choice(WORDS)}{k}.example/{rng.choice(WORDS)}" for k in range(60)),
        "tags": "\n".join(rng.choice(("#gift", "in stock", "free shipping", "SKU 123", "12% off", "best seller")) for _ in range(150)),
        "stuffed": " ".join("Why gift limit? Because gift limit means gift limit. The best gift limit is gift limit." for _ in range(30)),
        "within": prose(rng, 1) + "\n\n" + " | ".join(rng.choice(WORDS) + " near me" for _ in range(150)) + "\n\n" + prose(rng, 1),
    }
    rows = [(k, t, rng.choice(("en", None, "und")), 1) for k, t in {**good, **bad}.items()] * 2 + [(None, bad["urls"], "en", 1)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, blocks int").repartition(3)
    got = spam_scores(df, "doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    assert {r["doc_id"] for r in got if r["is_spam"]} == {*bad, None}
    assert all(r["spam_share"] == 0 for r in got if r["doc_id"] in ("short", "blank", "empty", "null"))
    # what is found passes both tests of the method
    assert all(r["deviation"] <= -4 and r["sentence_ends"] < punctuation_limit(r["deviation"], 4) for r in got if r["is_spam"])
    assert spam_scores(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_nothing_is_spam_without_compression():
    text = "\n".join(f"http://site{k}.example/page" for k in range(60))
    blocks, aside = measure(text, "en")
    assert judge(blocks, aside, "en", {})[0] > 0.9
    # the same blocks with the shares that prose has: no sentence end, yet no spam
    assert judge([(c, n, 0.55, 0.2, e, w) for c, n, _, _, e, w in blocks], aside, "en", {})[0] == 0


def test_skeletons():
    en = FUNCTION_WORDS["en"]
    assert skeleton("See https://a.example/x?id=5 and the Board, 12.5 of it.", en, {}) == "W u and the W , 0 of it ."
    one = skeleton("Need gift lawyer in Dale? Ask the lawyer. Need tax lawyer in West End? Ask the tax lawyer.", en, {})
    assert sentences(one) == 2 and sentences(skeleton("http://a.example/x.html. http://b.example/y. ", en, {})) == 0


def test_language_of_the_whole_text():
    en, es = "The gift of the council is in the report and may be of that member. ", "El regalo de la ciudad es para los que no han sido parte de una reunion con el. "
    text = en * 60 + es * 400 + en * 30
    assert language(text, None) == language(text, "und") == "es" and language(text, "en") == "en" and language(text, "fr") == "other"
    assert language(en * 10, " ") == "en" and language("xyz " * 50, None) == "other"
