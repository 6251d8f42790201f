import itertools
import random

from corrspark.functions import words as W

PORTER = dict(
    caresses="caress", ponies="poni", cats="cat", feed="feed", agreed="agre", plastered="plaster", motoring="motor",
    sing="sing", conflated="conflat", troubled="troubl", sized="size", hopping="hop", falling="fall", hissing="hiss",
    filing="file", happy="happi", relational="relat", conditional="condit", rational="ration", digitizer="digit",
    radicalli="radic", vietnamization="vietnam", operator="oper", decisiveness="decis", hopefulness="hope",
    formaliti="formal", sensibiliti="sensibl", triplicate="triplic", electrical="electr", goodness="good",
    revival="reviv", allowance="allow", adjustable="adjust", replacement="replac", adoption="adopt",
    effective="effect", probate="probat", rate="rate", cease="ceas", controll="control", roll="roll",
    injection="inject", vulnerabilities="vulner", authentication="authent", sky="sky", dying="die",
)


def test_porter():
    assert {w: W.stem(w) for w in PORTER} == PORTER
    assert W.stem("IS") == "is"


def common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_length_and_ratio():
    draw = random.Random(1)
    for _ in range(300):
        a, b = ("".join(draw.choices("abcé", k=draw.randint(0, 80))) for _ in range(2))
        assert W.common_length(a, b) == common(a, b)
        if a or b:
            assert W.ratio(a, b) == round(200 * common(a, b) / (len(a) + len(b)))
    assert W.ratio("apache", "apachee") == 92
    assert W.partial_ratio("http", "the http server") == 100


def test_lemmas_and_tokens():
    assert [W.noun_lemma(w) for w in ("servers", "classes", "boxes", "policies", "men", "status", "mice", "is")] == [
        "server", "class", "box", "policy", "man", "status", "mouse", "is"]
    assert W.tokens("a-b v1.2, x!") == ["a-b", "v1.2", ",", "x", "!"]
