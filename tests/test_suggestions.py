from tests.spans import frame, span
from wattspan.operators.detect import detect_n_plus_one
from wattspan.operators.suggestions import enrich_suggestions


def fix(spark, **own):
    rows = [span(i, f"SELECT * FROM t WHERE id = {i}", i, **own) for i in range(5)]
    return enrich_suggestions(detect_n_plus_one(frame(spark, rows))).first().suggested_fix


def test_frameworks(spark):
    assert fix(spark, scopes=["io.opentelemetry.hibernate-reactive-1.0"]).framework == "java_quarkus_reactive"
    assert fix(spark, scopes=["x", "io.opentelemetry.spring-data-3.0"]).framework == "java_jpa"
    assert fix(spark, service="helidon-mp-shop").framework == "java_helidon_mp"
    assert fix(spark) is None
