"""A sector model from files of uses: offsets by header, prefixes, what is left out."""

import numpy as np
import pytest

from tallyforge.operators import io_model as io
from tallyforge.operators import use_table as U

RULES = [("4", "SHOPS"), ("41", "FARMS"), ("412", "SHOPS"), ("7", "FARMS"), ("9", None), ("V", None), ("T", None), ("F", None)]


@pytest.fixture
def rules(spark):
    return spark.createDataFrame(RULES, "prefix string, sector string")


def flows(spark, *rows):
    return spark.createDataFrame(rows, "row string, column string, value double")


def test_files_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "one.txt").write_text("Commodity  Industry   PurVal     IOYear\n400001     41a        12.5       2002\n400002     410        .          2002\n400003     410                   2002\n\n", "latin-1")
    (tmp_path / "two.txt").write_text("xxIndustry  CaféCommodity PurVal IOYear\n  700         é 412345    -3e2   2002\n  701           412345    n/a    2002\n  7\n", "latin-1")
    found = U.use_table_files(spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [("400001", "41A", 12.5), ("412345", "700", -300.0)]


def test_a_file_without_header_is_an_error(spark):
    lines = spark.createDataFrame([("a", "Commodity Industry PurVal IOYear"), ("b", "400001 410 5")], "file string, value string")
    with pytest.raises(Exception, match="no header in b"):
        U.use_lines(lines).collect()


def test_the_longest_prefix_counts(spark, rules):
    codes = spark.createDataFrame([("4",), ("41",), ("4111",), ("4129",), ("419",), ("99",), ("5",), ("",), ("4111",)], "code string")
    found = U.concordance(codes, rules.selectExpr("*", "true AS known"))
    assert {r.code: r.sector for r in found.collect()} == {"4": "SHOPS", "41": "FARMS", "4111": "FARMS", "4129": "SHOPS", "419": "FARMS", "99": None, "5": None, "": None}


def test_model_and_ledger(spark, rules):
    rows = U.classified(
        flows(
            spark, ("40", "70", 20.0), ("70", "40", 10.0), ("40", "40", 5.0), ("41", "40", 5.0), ("99", "40", 7.0), ("V001", "40", 30.0), ("V00200", "40", 3.0), ("V003", "70", 60.0),
            ("V009", "40", 500.0), ("T005", "70", 900.0), ("40", "F010", 800.0), ("70", "99", 4.0), ("70", "99", 0.0), ("40", "70", 0.0), ("5", "70", 1.0),
        ),
        rules,
    ).cache()
    assert {(r.i, r.j): r.z for r in U.sales(rows).collect()} == {("SHOPS", "FARMS"): 20, ("FARMS", "SHOPS"): 15, ("SHOPS", "SHOPS"): 5}
    account = {r.sector: r for r in U.accounts(rows).collect()}
    shops, farms = account["SHOPS"], account["FARMS"]
    assert (shops.labor, shops.taxes, shops.capital, shops.energy, shops.x) == (30, 3, 0, 0, 60)
    assert (farms.labor, farms.taxes, farms.capital, farms.energy, farms.x) == (0, 0, 60, 0, 81)
    assert {r.sector: round(r.v, 9) for r in U.intensities(U.accounts(rows)).collect()} == {"SHOPS": round(33 / 60, 9), "FARMS": round(60 / 81, 9)}
    left = {(r.side, r.code): (r.fate, r.n, r.value) for r in U.ledger(rows).collect()}
    assert left == {("column", "99"): ("dropped", 1, 4), ("column", "F010"): ("dropped", 1, 800), ("row", "99"): ("output only", 1, 7), ("row", "5"): ("output only", 1, 1), ("row", "V009"): ("ignored", 1, 500), ("row", "T005"): ("ignored", 1, 900)}


def test_no_output_is_an_error(spark, rules):
    rows = U.classified(flows(spark, ("40", "70", -20.0), ("70", "40", 10.0)), rules)
    with pytest.raises(Exception, match="output of FARMS is not positive"):
        U.accounts(rows).collect()


def test_multipliers_against_numpy(spark):
    from tallyforge import registry
    from tallyforge.plans import uses

    data, names = "/root/testdata/sf0.001", uses.SECTORS
    a = np.zeros((len(names), len(names)))
    for r in registry.queries()["use_table_coefficients"](spark, data).collect():
        a[names.index(r.i), names.index(r.j)] = r.a
    want = np.linalg.inv(np.eye(len(names)) - a).sum(0)
    found = {r.sector: r.multiplier for r in registry.queries()["use_table_multipliers"](spark, data).collect()}
    assert [found[s] for s in names] == pytest.approx(want, abs=1e-4)
    assert io.NEGLIGIBLE < min(want) - 1


def test_lines_are_read_once(spark, rules):
    """Sums of flows are written once, though codes of both sides and the flows are read from them; headers kept apart spare a second reading of lines."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    head = spark.createDataFrame([("a", "Commodity  Industry   PurVal     IOYear")], "file string, value string")
    body = spark.createDataFrame([("a", "400001     700        12.5       2002"), ("a", "V00100     410        3.5        2002")], "file string, value string")
    lines = head.unionByName(body).mapInArrow(counted, "file string, value string")
    got = U.classified(U.use_lines(lines, head), rules)
    assert sorted((r.row, r.column, r.value, r.row_sector, r.sector, r.kind) for r in got.collect()) == [("400001", "700", 12.5, "SHOPS", "FARMS", "input"), ("V00100", "410", 3.5, None, "FARMS", "labor")]
    assert seen.value == 3
