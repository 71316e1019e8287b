"""The toxicity lexicon: whole words first, stems only for words never seen."""

from millrace.llm import toxicity


def test_a_seen_word_never_takes_the_score_of_its_stem(spark):
    rows = [(f"line {i} some plain words {'vermin' if i % 2 else 'verminous'} here", 1) for i in range(200)]
    rows += [(f"line {i} some plain words vermicelli here", 0) for i in range(40)] + [(f"line {i} other plain harmless sentences here", 0) for i in range(400)]
    scores, _ = toxicity.fit_lexicon(spark.createDataFrame(rows, "text string, label int"))
    assert toxicity.gain("vermin", scores) > 0 and toxicity.gain("verminous", scores) > 0
    assert scores["vermicelli"] == 0 and toxicity.gain("vermicelli", scores) == 0
    assert toxicity.gain("verminlike", scores) > 0 and toxicity.gain("vermi", scores) == 0


def test_the_lexicon_has_no_cap():
    assert not hasattr(toxicity, "MAX_LEXICON")
