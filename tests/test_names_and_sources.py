"""Names, files and pages."""

import datetime
import difflib
import random

import pytest
from pyspark.sql import functions as F

from duelbook.functions import clean, names
from duelbook.schema import RATED_REQUIRED
from duelbook.sources import files
from duelbook.sources.odds import extract_odds


@pytest.mark.parametrize("cutoff", [0.6, 0.7])
def test_closest_name_is_difflibs(spark, cutoff):
    rng = random.Random(3)
    parts = ["roger", "rafa", "nuno", "jo", "novak", "carlos", "anna", "maria", "iga", "li"]
    known = sorted({f"{rng.choice(parts)} {rng.choice(parts)}{rng.choice(['', 's', 'ez'])}" for _ in range(60)})
    asked = sorted({"".join(c for c in n if rng.random() > 0.2) for n in known} | {"zzz", "a"})
    queries = spark.createDataFrame([(a,) for a in asked], "query string")
    table = spark.createDataFrame([(k,) for k in known], "name string")
    got = {r["query"]: r["name"] for r in names.closest_name(queries, table, cutoff).collect()}
    for a in asked:
        best = difflib.get_close_matches(a, known, n=1, cutoff=cutoff)
        assert got.get(a) == (best[0] if best else None), a


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("cutoff", [0.51, 0.6, 0.75, 0.9])
def test_closest_name_by_edits(spark, cutoff):
    """Against every pair; few texts are left to compare."""
    rng = random.Random(int(cutoff * 100))
    parts = ["roger", "rafa", "nuno", "jo", "novak", "carlos", "anna", "maria", "iga", "li", "åsa", "o", "aaa"]
    known = sorted({f"{rng.choice(parts)} {rng.choice(parts)}{rng.choice(['', 's', 'ez', 'aa'])}" for _ in range(250)} | {"a", "ab"})
    noise = lambda n: "".join(rng.choice(["", c, c, c, c, c + rng.choice("aez ")]) for c in n)
    asked = sorted({noise(n) for n in known} - {""} | {"zzz", "a", "aaaaaa"})
    queries = spark.createDataFrame([(a,) for a in asked] + [(None,), ("",)], "query string")
    table = spark.createDataFrame([(k,) for k in known] + [(None,), ("",), (known[0],)], "name string")
    got = {r["query"]: (r["score"], r["name"]) for r in names.closest_name(queries, table, cutoff, "levenshtein").collect()}
    for a in asked:
        best = max((1 - distance(a, k) / max(len(a), len(k)), k) for k in known)
        assert got.get(a) == (best if best[0] >= cutoff else None), a
    pairs = [tuple(r) for r in names._near_candidates(queries, table, cutoff).collect()]
    assert len(pairs) == len(set(pairs))
    if cutoff >= 0.75:
        assert len(pairs) <= 12 * len(asked)


def test_aliases_take_one_hop(spark):
    aliases = spark.createDataFrame([("A", " B"), ("B", "A"), ("C", "A"), ("D", "D")], "old_name string, new_name string")
    df = spark.createDataFrame([(n,) for n in "ABCDE"], "n string")
    assert sorted(r.n for r in names.resolve_aliases(df, "n", aliases).collect()) == ["A", "A", "B", "D", "E"]


def test_pair_text(spark):
    df = spark.createDataFrame([("A - B",), ("A-B",), ("Jo-W - B",), ("A",)], "t string")
    got = [r.p for r in df.select(names.split_pair(F.col("t")).alias("p")).collect()]
    assert got == [["A", "B"], ["A", "B"], None, None]
    blank = [r.p for r in df.select(names.split_pair(F.col("t"), " - ").alias("p")).collect()]
    assert blank == [["A", "B"], None, ["Jo-W", "B"], None]


def test_capitalise_is_not_per_word(spark):
    row = spark.sql("select ' hARD court ' as s").select(names.capitalise(F.col("s")).alias("s")).first()
    assert row.s == "Hard court"


def test_dates(spark):
    df = spark.createDataFrame([(20240131,), (20241301,), (None,)], "d int")
    tolerant = [r.d for r in df.select(clean.parse_date(F.col("d"), coerce=True).alias("d")).collect()]
    assert tolerant == [datetime.date(2024, 1, 31), None, None]
    with pytest.raises(Exception, match="not a YYYYMMDD date"):
        df.select(clean.parse_date(F.col("d")).alias("d")).collect()


def test_h2h_text(spark):
    df = spark.createDataFrame([(1, 7), (0, 0)], "w long, l long")
    got = [r.t for r in df.select(clean.format_h2h(F.col("w"), F.col("l"), F.lit("A")).alias("t")).collect()]
    assert got == ["1-7 (12% para A)", "Igual (sem confrontos anteriores)"]


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))


def test_tiers_align_by_name_and_may_miss(spark, tmp_path):
    write(tmp_path / "atp_matches_2020.csv", "tourney_date,match_num,winner_name,w_ace\n20200105,1,José,5\n", "latin-1")
    write(tmp_path / "atp_matches_2021.csv", "tourney_date,match_num,winner_name,w_ace\n20210105,2,Ann,x\n", "latin-1")
    write(tmp_path / "atp_matches_qual_chall_2021.csv", "match_num,tourney_date,winner_name\n3,20210106,Bob\n", "latin-1")
    args = {"tiers": ("tour", "qual_chall", "futures"), "encoding": "ISO-8859-1"}
    df = files.read_matches(spark, str(tmp_path), "atp", [2020, 2021], **args)
    rows = {r.match_num: (r.tier, r.winner_name, r.w_ace, r.tourney_date.year) for r in df.collect()}
    assert rows == {1: ("tour", "José", 5.0, 2020), 2: ("tour", "Ann", None, 2021), 3: ("qual_chall", "Bob", None, 2021)}
    assert files.read_matches(spark, str(tmp_path), "atp", None, **args).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_matches(spark, str(tmp_path), "atp", [2019, 2020], **args)


def test_headers_of_any_order_in_any_folder(spark, tmp_path):
    """Names with blanks, accents, percent signs and pattern letters; a quoted header, a BOM, an empty file, unknown columns."""
    folder = tmp_path / "my dátà 100% {x}[1]"
    folder.mkdir()
    write(folder / "atp_matches_2020.csv", "match_num,tourney_date,winner_name\n1,20200105,A\n")
    write(folder / "atp_matches_2021.csv", "\ufeff\"winner_name\",tourney_date,match_num\nB,20210105,2\n")
    write(folder / "atp_matches_2022.csv", "match_num,tourney_date,winner_name,venue,venue\n3,20220105,C,x,y\n")
    write(folder / "atp_matches_2023.csv", "")
    escaped = str(folder).replace("{", "\\{").replace("}", "\\}").replace("[", "\\[").replace("]", "\\]")
    df = files.read_matches(spark, escaped, "atp", None, others=True, layout={"tour": "atp_matches_????.csv"})
    rows = {r.match_num: (r.winner_name, r.tourney_date.year, r.others) for r in df.collect()}
    assert rows == {1: ("A", 2020, {}), 2: ("B", 2021, {}), 3: ("C", 2022, {"venue3": "x", "venue4": "y"})}


def test_players_by_position(spark, tmp_path):
    write(tmp_path / "p.csv", "player_id,first,last,hand,dob,ioc\n7,A,B,R,1990,POR\n")
    assert files.read_players(spark, str(tmp_path / "p.csv")).first().asDict() == {
        "player_id": 7, "first": "A", "last": "B", "ioc": "POR"}


def test_alias_file(spark, tmp_path):
    write(tmp_path / "a.csv", "old,new\nA B, B A\nC,D\n")
    assert [tuple(r) for r in files.read_aliases(spark, str(tmp_path / "a.csv")).collect()] == [("A B", "B A"), ("C", "D")]


def test_missing_columns_raise_before_work(spark, tmp_path):
    path = str(tmp_path / "rated")
    spark.createDataFrame([("A",)], "winner_name string").write.parquet(path)
    with pytest.raises(ValueError, match="loser_name"):
        files.read_rated(spark, path)
    assert "winner_name" in RATED_REQUIRED


def test_odds_page(spark):
    def cells(*odds):
        return "".join(f'<td class="course">{o}</td>' for o in odds)

    html = (
        '<table class="result"><tbody><tr><td class="t-name">X - Y</td></tr></tbody></table>'
        '<div id="tournamentTabs-1-data"><table class="big result"><thead><tr><td class="t-name">H - I</td></tr></thead><tbody>'
        f'<tr class="one"><td class="first t-name"><a href="#">A</a> - B</td>{cells("1.5", "2.5")}</tr>'
        f'<tr><td class="t-name">C - D</td>{cells("1.5", "n/a")}</tr><tr><td class="t-name">E - F</td>{cells("1.5")}</tr>'
        f'<tr><td class="t-name">Jo-W - G</td>{cells("1.5", "2.5")}</tr><tr><td>no name</td></tr></tbody></table></div>')
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    got = [tuple(r) for r in extract_odds(pages).collect()]
    assert got == [(1, "A", "B", 1.5, 2.5), (1, "C", "D", None, None), (1, "E", "F", None, None)]
