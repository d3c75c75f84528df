"""The published examples of each step, and whole words."""

from parlance.functions import porter

# The examples of the published description, and words of its sample vocabulary.
PAIRS = """caresses caress, ponies poni, ties ti, caress caress, cats cat, feed feed, agreed agre, plastered plaster, bled bled, motoring motor, sing sing, conflated conflat, troubled troubl, sized size, hopping hop, tanned tan, falling fall,
hissing hiss, fizzed fizz, failing fail, filing file, happy happi, sky sky, relational relat, conditional condit, rational ration, valenci valenc, hesitanci hesit, digitizer digit, conformabli conform, radicalli radic, differentli differ,
vileli vile, analogousli analog, vietnamization vietnam, predication predic, operator oper, feudalism feudal, decisiveness decis, hopefulness hope, callousness callous, formaliti formal, sensitiviti sensit, sensibiliti sensibl, triplicate triplic,
formative form, formalize formal, electriciti electr, electrical electr, hopeful hope, goodness good, revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop, adjustable adjust, defensible defens, irritant irrit,
replacement replac, adjustment adjust, dependent depend, adoption adopt, homologou homolog, communism commun, activate activ, angulariti angular, homologous homolog, effective effect, bowdlerize bowdler, probate probat, rate rate, cease ceas,
controll control, roll roll, generalizations gener, oscillators oscil, yellow yellow, saying sai, enjoyed enjoi, toy toi, by by, is is, a a, été été, abc1s abc1s, dying dy, eying ei, flies fli, owed ow, sensational sensat, argument argument""".replace("\n", " ")


def test_published_pairs(spark):
    pairs = [tuple(p.split()) for p in PAIRS.split(",")]
    df = spark.createDataFrame([(a,) for a, _ in pairs] + [(None,), ("",)], "word string")
    got = {r.word: r.s for r in df.select("word", porter.stem(df.word).alias("s")).collect()}
    assert got == dict(pairs) | {None: None, "": ""}
