import math

import pytest
from pyspark.sql import functions as F

from metaloam.functions import measure, parse, tails, text, vectors


def value(spark, column, **literals):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in literals.items())).select(column).first()[0] if literals else spark.range(1).select(column).first()[0]


def test_keyword_cleaning_needs_both_braces(spark):
    assert value(spark, text.clean_text(F.lit("{a b, c}"), True)) == "a b c"
    assert value(spark, text.clean_text(F.lit("{a, b"), True)) == "{a b"


def test_lenient_match(spark):
    assert value(spark, text.lenient_match(F.lit("animal"), F.lit(" Animal ")))
    assert value(spark, text.lenient_match(F.lit("soil"), F.lit("topsoil")))
    assert not value(spark, text.lenient_match(F.lit(None).cast("string"), F.lit("banana")))
    assert value(spark, text.lenient_match(F.lit(None).cast("string"), F.lit("banana"), null_is_text=True))


def test_coordinates_and_distance(spark):
    assert value(spark, measure.dms_to_decimal(F.lit("12°30'S"))) == -12.5
    assert value(spark, measure.dms_to_decimal(F.lit("45.5 N"))) == 45.5
    assert value(spark, measure.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(6371 * math.pi / 180)
    assert value(spark, measure.clock_seconds(F.lit("3' 17''"))) == 197


def test_annotated_and_keys(spark):
    label, code, prefix = text.annotated(F.lit("soil [envo:00001998]"))
    assert tuple(spark.range(1).select(label, code, prefix).first()) == ("soil", "ENVO:00001998", "ENVO")
    assert value(spark, text.normalise_key(F.lit("Sample_Depth (m)"))) == "depth"
    assert value(spark, text.key_values(F.lit("a=1; b=2; a=3"))) == {"b": "2", "a": "3"}
    assert value(spark, text.place_names(F.lit("USA: Texas"))) == "United StatesA  Texas"
    assert value(spark, text.sequence_ratio(F.lit("abcd"), F.lit("bcde"))) == 0.75
    assert value(spark, text.fold_accents(F.lit("Forêt_noire!"))) == "foret noire"


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(float("nan")), F.lit(2.0))
    assert value(spark, vectors.norm(a)) == 5
    assert value(spark, vectors.average(a, b)) == [3.0, 3.0]
    assert not value(spark, vectors.finite(b))
    assert sum(value(spark, vectors.softmax(a))) == pytest.approx(1)


def test_tails():
    assert tails.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert tails.chi2_sf(30.0, 4) == pytest.approx(4.894437128029217e-06, rel=1e-9)
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert tails.fisher_exact(8, 2, 1, 5) == pytest.approx(0.03496503496503495)
    assert tails.mcnemar(10, 2)[0] == pytest.approx(49 / 12)


def test_hemispheres_stand_alone(spark):
    for said, degrees in (("45 degrees N", 45.0), ("51 North latitude, mesured", 51.0), ("10,5 S", -10.5), ("7 south", -7.0), ("W 3.25", -3.25), ("-4", -4.0), ("30°15'S", -30.25), ("no place", None)):
        assert value(spark, measure.dms_to_decimal(F.lit(said))) == degrees


def test_depth_classes(spark):
    for said, unit, metres in (("15cm", "cm", 0.15), ("3 in", "inches", 0.0762), ("20 mm", "mm", 0.02), ("7mbsf", "mbsf", 7.0), ("4 m bgs", "bgs", 4.0), ("2 fathoms", "other", 2.0)):
        assert value(spark, measure.depth_class(F.lit(said))) == unit
        assert value(spark, measure.depth_to_metres(F.lit(said), F.lit(unit))) == pytest.approx(metres)


def test_measurement_rules(spark):
    cases = (("NA", "missing", None), ("Sea level.", "sea_level", 0.0), ("2300 masl", "masl", 2300.0), ("500 ft", "feet", 152.4), ("1.2 km", "km", 1200.0), ("12,5", "bare_number", 12.5), ("100-200", "range_or_composite", None), ("1.234,56", "bare_number", 1.23456), ("abc", "other", None))
    for said, unit, metres in cases:
        assert value(spark, measure.unit_class(F.lit(said))) == unit
        got = value(spark, measure.to_metres(F.lit(said), F.lit(unit)))
        assert got == metres if metres is None else got == pytest.approx(metres)


def test_lists_are_trimmed_whole(spark):
    assert value(spark, text.split_values(F.lit(" a ; b  ;c "))) == ["a", "b", "c"]
    assert value(spark, text.key_values(F.lit(" a = 1 ; b=2;a=3"))) == {"a": "3", "b": "2"}


def test_ids_and_answers(spark):
    assert value(spark, text.dois(F.lit("see DOI:10.1/x, and doi:10.2/y."))) == ["DOI:10.1/x", "doi:10.2/y"]
    assert value(spark, text.project_ids(F.lit("PRJEB12 bioproject 34; BioProject: 34"))) == ["PRJEB12", "PRJNA34"]
    assert [tuple(r) for r in value(spark, parse.candidates(F.lit("a:b:0.5;c:1;none")))] == [("a:b", 0.5), ("c", 1.0)]
    assert value(spark, parse.grouped_integer(F.lit("1,234,567 rows"))) == 1234567
    assert tuple(value(spark, parse.loose_fields(F.lit("x {'k': 'v', \"w\": 2} y"), ("a", "b", "c")))) == ("v", "2", "N/A")
