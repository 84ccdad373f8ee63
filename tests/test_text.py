import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from recurq.functions import text as T
from recurq.operators import generate
from recurq.operators import quality as Q


@pytest.fixture(scope="module")
def one(spark):
    def run(build, *values):
        df = spark.createDataFrame([(i, *([v] if not isinstance(v, tuple) else v)) for i, v in enumerate(values)], "i int, x string" + (", y string" if isinstance(values[0], tuple) else ""))
        return [r.r for r in df.orderBy("i").select(build.alias("r")).collect()]

    return run


@pytest.fixture(scope="module", autouse=True)
def columns(spark):
    global x, y
    x, y = F.col("x"), F.col("y")


def test_candidate_filter_golden_cases(one):
    raw = ["hola", "Gracias por la informacion", "mi correo es cliente@example.com", "Quiero reservar una clase de cortesia", "aaaaaaaaaaaa aaaa", None]
    got = one(T.candidate_reject_reason(x, x), *raw)
    assert [g is None for g in got] == [False, False, False, True, False, False]


def test_canonical_questions(one):
    got = one(T.clean_canonical_question(x), "Quisiera agendar una clase de prueba mañana 6.30 am", "Puedo pagar con la mitad")
    assert got == ["¿Cómo puedo agendar una clase de prueba?", "¿Es posible reservar pagando un anticipo?"]


def test_personal_data(one):
    (got,) = one(T.redact_personal_data(x), "Hola Juan Perez, escribe a cliente@example.com o al 300 123 4567")
    assert "[correo]" in got and "[telefono]" in got and "Juan" not in got
    (kept,) = one(T.redact_personal_data(x, y), ("Bienvenido a Casa Verde Grande, somos Casa Verde Grande", "Casa Verde Grande"))
    assert "Casa Verde Grande" in kept


def test_answers(one):
    (got,) = one(T.clean_faq_answer(x), "Hola Juan, para tu día de cortesía te ayudamos a reservar por WhatsApp")
    assert got.startswith("Para el día de cortesía") and "Hola" not in got and "te ayudamos" not in got
    long = "Una frase corta aqui. " + "palabra " * 80
    assert one(T.compact_answer(x), long, "corta", "palabra " * 60) == ["Una frase corta aqui.", "corta", " ".join(["palabra"] * 55) + "."]


def test_fold_matches_decomposition(one):
    def want(t):
        d = unicodedata.normalize("NFKD", " ".join((t or "").split()).lower())
        return "".join(c for c in d if not unicodedata.combining(c))

    values = ["Ñandú  ÀÉÎõü", "a b\tc", "Çà ẞ Ğğ", None, "é"]
    assert one(T.fold_text(x), *values) == [want(v) for v in values]
    assert one(T.fold_text_udf()(x), *values) == [want(v) for v in values]


def test_word_count_and_tokens(one):
    assert one(T.word_count(x), "uno dos, tres_3 ¿sí?", "") == [4, 0]
    assert one(T.support_tokens(x), "Quiero el envío del pedido, PEDIDO y envio") == [["envio", "pedido"]]


def test_question_and_answer_validity(one):
    good = ["¿Ofrecen clases de prueba?", "¿Hacen envios a otras ciudades?", "¿Se puede pagar con tarjeta?"]
    bad = ["hola ¿tienen clases?", "¿quiero?", "¿mi pedido ya llego a casa?", "¿" + "palabra " * 20 + "?", "Tienen clases", "¿Abren el lunes a las 6:30 am?"]
    assert one(Q.is_valid_question(x), *good) == [True] * 3
    assert one(Q.is_valid_question(x), *bad) == [False] * 6
    assert one(Q.is_valid_answer(x), "El envio tiene costo adicional segun la ciudad.") == [True]
    assert one(Q.is_valid_answer(x), "Por favor indique su ciudad para continuar.", "Escribe a [correo] para mas datos del plan.", "palabra " * 60) == [False] * 3


def test_alignment_of_question_and_answer(one):
    free = "El domicilio es gratis desde $130.000 en compras."
    assert one(Q.is_aligned(x, y), ("¿Qué vale el domicilio?", free), ("¿Desde qué valor el domicilio es gratis?", free)) == [False, True]


def test_intents(one):
    assert one(Q.intents(x), "quiero pagar y reservar", "quiero reservar", "desayuno con domicilio", "nada") == [["payment"], ["scheduling"], ["product_availability", "shipping"], []]


def test_parse_generation():
    body = '{"publish": true, "canonical_question": "q", "canonical_answer": "a", "confidence": 0.5, "reason": "r"}'
    for raw in (body, f"<think>x {{y}}</think>{body}", f"well: {body} done"):
        assert generate.parse_generation(raw)["canonical_question"] == "q"
    assert generate.parse_generation(body.replace("true", "false"))["publish"] is False
    assert generate.parse_generation("{publish: true") is None
    fixed = generate.parse_generation(body.replace("0.5", "0.0").replace('"r"', '"La intención es clara"'))
    assert fixed["confidence"] == 0.45 and fixed["repaired"]


def test_evidence(spark):
    df = spark.createDataFrame([(1,)], "i int")

    def level(q, a, questions, answers):
        arr = lambda v: F.array(*[F.lit(t) for t in v]).cast("array<string>")
        return df.select(Q.evidence_support(F.lit(""), F.lit(""), F.lit(q), F.lit(a), arr(questions), arr(answers)).alias("s")).first().s

    s = level("¿Se puede personalizar la media?", "Sí, se puede personalizar la media.", ["personalizan medias media"], ["Por ahora no personalizamos la media negra."])
    assert s.level == "none" and s.hard_reject
    s = level("¿Cubren la ciudad?", "La cobertura segun ciudad puede variar mucho siempre.", ["cubren ciudad"], ["Podemos revisar cobertura segun ciudad."])
    assert s.level in ("partial", "weak") and s.answer_review


def test_tokens_pattern_is_ascii_after_folding():
    assert re.fullmatch("[a-z]+", "envio")
