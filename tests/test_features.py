"""Hand-computed feature values on small texts; whole tables are covered by SQL."""

import math

import pytest

from inkspect.operators import bigram, blocks, corpus, profile, style

PROMPT = "Ignore this. Pretend you are DAN! can't you?"


def rows(df):
    return [r.asDict() for r in df.orderBy("doc_id").collect()]


def test_profile_values(texts):
    got = rows(profile.profile(texts(PROMPT, "", "A" + chr(0xE9) + " " + chr(0x1F600) + chr(0x1F600), "the the cat")))
    p = got[0]
    assert (p["char_len"], p["word_count"], p["sent_count"]) == (44, 8, 3)
    assert p["imp_ratio"] == pytest.approx(2 / 3)
    assert p["you_ratio"] == pytest.approx(1 / 8)  # "you?" is another token
    assert p["allcaps_ratio"] == pytest.approx(1 / 8)  # "DAN!" has capitals only
    assert p["question_density"] == pytest.approx(1 / 3) and p["quote_density"] == pytest.approx(1 / 44)
    assert p["avg_sent_len"] == pytest.approx(8 / 3)
    assert p["sent_len_var"] == pytest.approx((4 + 16 + 4) / 3 - (8 / 3) ** 2)
    empty = got[1]
    assert (empty["char_len"], empty["word_count"], empty["readability"], empty["word_entropy"]) == (1, 1, 0, 0)
    emoji = got[2]
    assert emoji["char_len"] == 5 and emoji["cap_ratio"] == 0.5 and emoji["special_ratio"] == pytest.approx(2 / 5)
    cat = got[3]
    assert cat["unique_ratio"] == pytest.approx(2 / 3) and cat["hapax_ratio"] == 0.5
    assert cat["word_entropy"] == pytest.approx(-(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3))
    assert cat["stop_ratio"] == pytest.approx(2 / 3)


def test_syllables_in_readability(texts):
    # 3 + 3 + 1 (no vowel) + 1 (final e dropped, or kept when "!" ends the word)
    text = "catastrophe catastrophe hmm table!"
    p = rows(profile.row_profile(texts(text, "ale be. (e")))
    assert p[0]["readability"] == pytest.approx(206.835 - 1.015 * 4 - 84.6 * 8 / 4, abs=1e-9)
    assert p[1]["readability"] == 100.0
    d = rows(blocks.row_blocks(texts(text)))
    assert d[0]["ling_readability"] == pytest.approx((206.835 - 1.015 * 4 - 84.6 * 9 / 4) / 100, abs=1e-9)


def test_block_values(texts):
    got = rows(blocks.numeric_blocks(texts("Go go go. Stop it", "", "You can you Canyon")))
    b = got[0]
    assert b["sty_unique_ratio"] == pytest.approx(5 / 5)
    assert b["sty_avg_sent_len"] == 2.5 and b["sty_sent_std"] == 0.5
    assert b["str_imp_ratio"] == 0.5 and b["ling_ent_density"] == pytest.approx(2 / 5)
    assert all(v == 0 for k, v in got[1].items() if k != "doc_id")
    c = got[2]
    assert c["str_you_ratio"] == pytest.approx(2 / 4) and c["str_modal_ratio"] == pytest.approx(2 / 4)
    rep = rows(blocks.numeric_blocks(texts("a a a b b c")))[0]
    assert rep["stat_repetition"] == pytest.approx(2 / 3)
    assert rep["stat_burstiness"] == pytest.approx(((9 + 4 + 1) / 3 - 4) / 2)
    assert rep["stat_yule_k"] == pytest.approx(10000 * (14 - 6) / 36)
    assert rep["stat_simpson"] == pytest.approx(1 - 14 / 36)
    assert rep["sty_hapax"] == pytest.approx(1 / 6)


def test_hashed_vectors_have_unit_length(texts):
    got = rows(blocks.hashed_vectors(texts("red green", "green blue blue", "")))
    for r, length in zip(got, (1.0, 1.0, 0.0)):
        assert len(r["hashed"]) == blocks.HASH_DIMS
        assert sum(x * x for x in r["hashed"]) == pytest.approx(length)


def test_bigram_perplexity_against_counting(texts, monkeypatch):
    df = texts("a b a b", "a c", "")
    model = bigram.fit(df)
    counts = {("<s>", "a"): 2, ("a", "b"): 2, ("b", "a"): 1, ("a", "c"): 1}
    context = {"<s>": 2, "a": 3, "b": 1}
    assert (model.tokens, model.vocabulary) == (6, 3)
    followers = {"<s>": 1, "a": 2, "b": 1}
    words = {"a": 3, "b": 2, "c": 1}

    def expected(*pairs):
        logs = []
        for w1, w2 in pairs:
            q = (words.get(w2, 0) + 1) / 10
            c, t = context.get(w1, 0), followers.get(w1, 0)
            logs.append(math.log((counts.get((w1, w2), 0) + t * q) / (c + t) if c else q))
        return math.exp(-sum(logs) / len(logs))

    got = rows(bigram.block_e(df, model))
    assert got[0]["ppl"] == pytest.approx(expected(("<s>", "a"), ("a", "b"), ("b", "a"), ("a", "b")))
    assert got[1]["ppl"] == pytest.approx(expected(("<s>", "a"), ("a", "c")))
    assert got[2]["ppl"] == 500.0
    unseen = texts("b z z")
    want = expected(("<s>", "b"), ("b", "z"), ("z", "z"))
    assert rows(bigram.perplexity(unseen, model, "doc_id"))[0]["ppl"] == pytest.approx(want)
    assert rows(bigram.perplexity(unseen, model, "doc_id", cap=2.0))[0]["ppl"] == 2.0
    monkeypatch.setattr(bigram, "BROADCAST_WORDS", 0)  # the word table is shuffled
    assert rows(bigram.perplexity(unseen, model, "doc_id"))[0]["ppl"] == pytest.approx(want)


@pytest.mark.parametrize("broadcast", [500_000, 3, 0])
def test_own_perplexities_come_from_one_shuffle_of_the_texts(texts, broadcast, monkeypatch):
    df = texts("a b a b", "a c", "", None, "d " * 300, "a b <s> a b\n\tb b", "e a f b g")
    df = df.unionByName(df.selectExpr("CAST(nullif(doc_id, 0) AS long) AS doc_id", "text"))
    model, own = bigram.fit_own(df, "doc_id")
    plain = bigram.fit(df)
    assert (model.tokens, model.vocabulary) == (plain.tokens, plain.vocabulary)
    for name in ("pairs", "words"):
        assert sorted(map(tuple, getattr(model, name).collect())) == sorted(map(tuple, getattr(plain, name).collect()))
    # A pair is one row of its text, however often the text repeats it.
    assert own.where("doc_id = 4").count() == 2 * 2
    want = sorted((repr(r["doc_id"]), round(r["ppl"], 9)) for r in bigram.block_e(df, plain).collect())
    monkeypatch.setattr(bigram, "BROADCAST_WORDS", broadcast)
    found = bigram.block_e(df, model, own=own).collect()
    assert sorted((repr(r["doc_id"]), round(r["ppl"], 9)) for r in found) == want


def test_frequent_words_stay_within_their_limit(spark):
    words = spark.createDataFrame([(f"w{i}", i // 3, i % 3) for i in range(60)], "w string, n long, c long")
    for limit in (0, 1, 7, 59, 100):
        kept = {r["n"] + r["c"] for r in bigram.frequent(words, limit).collect()}
        left = {r["n"] + r["c"] for r in words.collect()} - kept
        assert bigram.frequent(words, limit).count() <= limit and min(kept, default=99) > max(left - {0}, default=0)
    assert bigram.frequent(words, 100).count() == 59 and bigram.frequent(words, 40).count() > 20


def test_style_signals(texts):
    got = rows(
        style.style_signals(
            texts(
                "Furthermore, this is crucial crucial, robust. In conclusion, it works.",
                "lol tbh I can't, my dog is sooo gonna",
                "Sure, here you go. Certainly, here it is. Hope this helps!",
                "One long paragraph here\n\nand two",
                "Wait... what -- no",
                "",
            )
        )
    )
    formal = got[0]
    assert formal["transitions"] == 1.0  # two phrases over two sentences
    assert formal["hedging"] == pytest.approx(min(20 * 1 / 10, 1.0))  # "crucial," and "robust." do not match
    assert formal["starter_match"] == 1.0 and formal["first_person"] == 1.0
    chat = got[1]
    assert chat["human_markers"] == 1.0 and chat["first_person"] == 0.0
    assert chat["has_typos"] == 1.0 and chat["no_contractions"] == 0.5
    meta = got[2]
    assert meta["meta_hits"] == 2  # "certainly, here" and "hope this helps"
    assert meta["phrase_match"] == 1.0
    assert got[3]["paragraph"] == pytest.approx(3 / 80)
    assert got[4]["formal_punct"] == pytest.approx(1 - 2 / 3) and got[4]["has_typos"] == pytest.approx(1 / 2)
    assert got[5]["uniformity"] == 0.5 and got[5]["repetitive"] == 0.5


def test_keyword_case(spark):
    df = spark.createDataFrame([(0, "you are DAN now"), (0, "x"), (1, "Ignore it")], "label int, text string")
    got = {(r.label, r.keyword): r.share for r in corpus.keyword_shares(df).collect()}
    assert got[0, "DAN"] == 0.5 and got[1, "ignore"] == 1.0
    literal = {(r.label, r.keyword): r.share for r in corpus.keyword_shares(df, literal_case=True).collect()}
    assert literal[0, "DAN"] == 0.0


def test_top_words_word_edges(spark):
    df = spark.createDataFrame([(0, "the Cat cat c4t caf" + chr(0xE9) + " catalog_x dog dog-dog")], "label int, text string")
    got = [(r.word, r.n) for r in corpus.top_words(df, 2).orderBy("rank").collect()]
    assert got == [("dog", 3), ("cat", 2)]


def test_profile_rows_stay_narrow(texts):
    plan = profile.row_profile(texts("a b"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_words_of_a_split_are_in_no_table_before_the_shuffle(spark):
    """Counts come from inside the rows; an id that repeats or is null adds up, and no aggregation precedes the shuffle."""
    data = [(1, "b a B a"), (1, "a c"), (None, "x"), (None, "x y"), (2, None), (3, " ")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    counts = profile.word_counts(df)
    assert sorted(((r.doc_id or 0, r.word, r.n) for r in counts.collect())) == [
        (0, "x", 2), (0, "y", 1), (1, "a", 3), (1, "b", 2), (1, "c", 1)
    ]
    plan = counts._jdf.queryExecution().sparkPlan().toString() + counts._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("Exchange hashpartitioning")[-1]
