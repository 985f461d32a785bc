import os

import pytest
from pyspark.sql import functions as F

from sparkpanel.functions import scalar as X
from sparkpanel.functions.names import normalize_colname
from sparkpanel.operators import clean as C
from sparkpanel.operators import schema as S
from sparkpanel.sources.io import read_csv_strings


@pytest.mark.parametrize("raw,expected", [
    ("  Nº Av ", "no_av"), ("Gênero", "genero"), ("Data de Nasc", "data_de_nasc"),
    ("INDE 22", "inde_22"), ("Fase (Ideal)", "fase_ideal"), ("a--b..c", "a_b_c"), ("Pedra/20", "pedra_20"),
])
def test_normalize_colname(raw, expected):
    assert normalize_colname(raw) == expected


def test_coerce_numeric_modes(spark):
    df = spark.createDataFrame([("R$ 1234,56",), ("Fase 2 (5º e 6º ano)",), ("6/17/2015",), ("1e5",),
                                ("1.234,5",), ("abc",), (None,), (" 7 ",)], "s string")
    strip = [r[0] for r in df.select(X.coerce_numeric("s")).collect()]
    assert strip == [1234.56, 256.0, 6172015.0, 15.0, None, None, None, 7.0]
    first = [r[0] for r in df.select(X.coerce_numeric("s", "first_number")).collect()]
    assert first[:2] == [1234.56, 2.0] and first[5] is None


def test_clean_string_and_accents(spark):
    df = spark.createDataFrame([("  a  b \t c  ",), ("Topázio Ágata ç Ñ",), ("",)], "s string")
    assert [r[0] for r in df.select(X.clean_string("s")).collect()] == ["a b c", "Topázio Ágata ç Ñ", ""]
    assert df.select(X.strip_accents("s")).collect()[1][0] == "Topazio Agata c N"


def test_ordinal_and_nonempty(spark):
    df = spark.createDataFrame([(" ÁGATA ", " x ", None), ("Topázio", "  ", "y"), ("Rubi", None, None)],
                               "p string, a string, b string")
    out = df.select(X.ordinal_encode("p", C.PEDRA_ORD_MAP).alias("o"),
                    X.count_non_empty(["a", "b"]).alias("n")).collect()
    assert [(r.o, r.n) for r in out] == [(1.0, 1), (3.0, 1), (None, 0)]


def test_coalesce_and_drop(spark):
    df = spark.createDataFrame([(None, 5), (10, None)], "cand1 int, cand2 int")
    out = S.coalesce_into(df, "target", ["cand1", "cand2"])
    assert out.columns == ["target"] and [r[0] for r in out.collect()] == [5, 10]
    df2 = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert S.drop_if_present(df2, ["b", "x"]).columns == ["a", "c"]


def test_clean_year_from_csv(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "year.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("RA;ANO_NASC;PEDRA_23;IPP;DESTAQUE_IPV;AVALIADOR1;Fase;Fase Ideal;Rec Av1\n")
        fh.write("001;2010;Ágata;5,5;x;y;3;Fase 2;sim\n")
        fh.write("002;2011;;NA;x;y;4;Fase 4;\n")
    raw = read_csv_strings(spark, path, sep=";")
    out = C.clean_period(raw, 2022)
    cols = set(out.columns)
    assert {"ra", "pedra", "idade", "ano", "gap_fase", "pedra_ord", "rec_av_count"} <= cols
    assert not {"destaque_ipv", "avaliador1", "pedra_23"} & cols
    rows = {r.ra: r for r in out.collect()}
    assert rows["001"].idade == 12.0 and rows["001"].ipp == 5.5 and rows["001"].pedra_ord == 1.0
    assert rows["002"].ipp is None and rows["002"].gap_fase == 0.0 and rows["002"].rec_av_count == 0
