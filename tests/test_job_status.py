"""Hand-derived job statuses; the case names are those of FIXTURES.md."""

import pytest

from shopfloor.constants import HEAD_QTY, LEGACY, OPEN_FIRM
from shopfloor.operators import evidence, status
from tests.shop import Shop, bag

NO_ROW: list = []


def one(value):
    return [("F001", "J", value)]


CASES = {
    "E1": (Shop().job(), one(None), one(0)),
    "E2": (Shop().job().mtl(), one(1), one(1)),
    "E3": (Shop().job().mtl(qty=-5), one(None), one(0)),
    "E4": (Shop().job().mtl().op("MILL", 10).labor(10, 2), one(4), one(4)),
    "E5": (Shop().job().op("HT-OVOP", 10, done=True), one(2), one(4)),
    "E6": (Shop().job().op("HT-OVOP", 10, done=True).op("MILL", 20).labor(20, 0), one(4), one(4)),
    "E7": (Shop().job().op("OMC-OVOP", 10, rel="open"), one(3), one(3)),
    "E8": (Shop().job().op("PL-OVOP", 10, done=True, rel="closed"), one(6), one(6)),
    "E9": (Shop().job().op("PL-OVOP", 10, rel="open").op("PL-OVOP", 20), one(5), one(5)),
    "E10": (Shop().job().op("PL-OVOP", 10, rel="open"), one(6), one(6)),
    "E11": (Shop().job().op("PL-OVOP", 10, rel="open").asm(1).mtl(1), one(1), one(6)),
    "E12": (Shop().job().mtl().op("MILL", 10).labor(10, 2).asm(1), one(0), one(4)),
    "E13": (
        Shop().job().op("PL-OVOP", 10, rel="open").asm(1).mtl(1).op("MILL", 10, 1).labor(10, 2, 3, asm=1),
        one(4),
        NO_ROW,
    ),
    "E14": (
        Shop().job().mtl().op("MILL", 10).labor(10, 1, 1).asm(1).op("MILL", 10, 1).labor(10, 1, 10, asm=1),
        one(4),
        one(4),
    ),
    "E15": (
        Shop().job().op("PL-OVOP", 10, rel="open").asm(1).mtl(1)
        .asm(2).mtl(2).op("MILL", 10, 2).labor(10, 1, 1, asm=2),
        one(1) + one(4),
        NO_ROW,
    ),
    "E16": (
        Shop().job().op("PL-OVOP", 10, rel="open").asm(1).mtl(1).asm(2).mtl(2),
        one(1) + one(1),
        one(6),
    ),
    "E17": (Shop().job(closed=True).mtl(), one(1), NO_ROW),
    "E18": (Shop().job(firm=False).mtl(), one(1), NO_ROW),
    "E19": (Shop().job(top=False), NO_ROW, NO_ROW),
    "E20": (Shop().job(top=False).asm(1).mtl(1), NO_ROW, NO_ROW),
    "E21": (
        Shop().job().job(company="F101").mtl(company="F101"),
        [("F001", "J", 1), ("F101", "J", 1)],
        [("F001", "J", 0), ("F101", "J", 1)],
    ),
    "E22": (Shop().job(qty=0).op("PL-OVOP", 10, rel="open").asm(1).mtl(1), one(1), one(6)),
    "E23": (
        Shop().job().op("PL-OVOP", 10).job(company="F101").op("PL-OVOP", 10, company="F101", rel="closed"),
        [("F001", "J", 6), ("F101", "J", 6)],
        [("F001", "J", 6), ("F101", "J", 6)],
    ),
    "E24": (Shop().job().asm(1).mtl(1), one(1), one(0)),
    # Bookings of an assembly that does not exist still drop the unbooked ones.
    "orphan bookings": (Shop().job().mtl().op("MILL", 10, 7).labor(10, 1, 1, asm=7), one(1), NO_ROW),
    # A release without sequence belongs to no operation.
    "release without sequence": (
        Shop().job().op("PL-OVOP", 10).add(
            "PORel", Company="F001", JobNum="J", AssemblySeq=0, JobSeq=None, OpenRelease=True
        ),
        one(None),
        one(0),
    ),
    # Unfinished assemblies are shared by the companies that use the job number.
    "shared assemblies": (
        Shop().job().mtl().job(company="F101").asm(1, company="F101"),
        [("F001", "J", 0), ("F101", "J", 0)],
        [("F001", "J", 1), ("F101", "J", 0)],
    ),
}


@pytest.fixture(scope="module")
def found(spark):
    """All cases in one set of tables, job J of a case under the name of the case."""
    together = Shop()
    for name, (shop, _, _) in CASES.items():
        for table, rows in shop.rows.items():
            together.rows[table] += [{**row, "JobNum": name} for row in rows]
    erp = together.erp(spark)
    return {mode: bag(status.job_status(erp, mode)) for mode in (LEGACY, OPEN_FIRM)}


@pytest.mark.parametrize("name", CASES)
def test_job_status(found, name):
    _, legacy, open_firm = CASES[name]
    for mode, expected in ((LEGACY, legacy), (OPEN_FIRM, open_firm)):
        assert [(c, "J", s) for c, j, s in found[mode] if j == name] == expected


def test_last_outside_operation_flag(spark):
    """E10: the last operation counts as not final under the legacy rules only."""
    erp = CASES["E10"][0].erp(spark)
    flags = [
        evidence.assembly_evidence(erp, mode).first()["OVNotFinal"] for mode in (LEGACY, OPEN_FIRM)
    ]
    assert flags == [1, 0]


def test_head_quantity_rule(spark):
    """E22: a job quantity of 0 is reached without bookings."""
    erp = CASES["E22"][0].erp(spark)
    assert bag(evidence.detail_complete_flag(erp, "head_qty")) == [("F001", "J", 0, 1), ("F001", "J", 1, 1)]
    assert bag(evidence.detail_complete_flag(erp, LEGACY)) == [("F001", "J", 0, 0), ("F001", "J", 1, 0)]


def test_one_row_per_job(spark):
    counted = status.job_status_counted(CASES["E15"][0].erp(spark), LEGACY)
    assert bag(status.job_status_one_row(counted)) == one(1)


def test_many_copies(spark, monkeypatch):
    """One path for every count: parts of parts, no long array."""
    from shopfloor.functions import bags

    df = spark.createDataFrame([("a", 1), ("b", 7), ("c", 50), ("d", 0), (None, 3)], "k string, Copies bigint")
    for step in (2, 3, 1000):
        monkeypatch.setattr(bags, "STEP", step)
        got = {r["k"]: r["count"] for r in bags.expand_copies(df).groupBy("k").count().collect()}
        assert got == {"a": 1, "b": 7, "c": 50, None: 3}
    big = spark.createDataFrame([("a", 2_345_678)], "k string, Copies bigint")
    assert bags.expand_copies(big).count() == 2_345_678


@pytest.mark.parametrize("name", CASES)
def test_third_rule_set(spark, name):
    """Completion by the job quantity: no assembly is left out, and one without bookings is unfinished."""
    shop = CASES[name][0]
    open_firm = CASES[name][2]
    expected = {
        "E11": one(1),
        "E12": one(0),
        "E13": one(4),
        "E15": one(1) + one(4),
        "E16": one(1) + one(1),
        "E22": one(6),
        "E24": one(1),
        "orphan bookings": one(1),
        "shared assemblies": [("F001", "J", 0), ("F101", "J", 0)],
    }.get(name, open_firm)
    assert bag(status.job_status(shop.erp(spark), HEAD_QTY)) == expected


def test_hot_job(spark):
    """A job with most of all assemblies gives every row, in both rule sets."""
    shop = Shop().job("HOT", qty=1000).op("PL-OVOP", 10, rel="open", job="HOT")
    for n in range(1, 401):
        shop.asm(n, "HOT")
        if n % 2:
            shop.mtl(n, job="HOT")
    for n in range(50):
        shop.job(f"J{n}").mtl(job=f"J{n}")
    rows = bag(status.job_status(shop.erp(spark), LEGACY))
    assert rows.count(("F001", "HOT", 1)) == 200
    assert rows.count(("F001", "HOT", 0)) == 200
    assert len(rows) == 450


def test_header_flags(spark):
    shop = Shop().job(JobReleased=True, JobEngineered=True, JobComplete=False)
    shop.rows["JobAsmbl"][0]["JobComplete"] = True
    shop.asm(1, JobComplete=True).asm(2, JobComplete=False)
    # Top: in process (4); the unfinished assembly is at 5 and does not pull it down.
    assert bag(status.header_flag_status(shop.erp(spark))) == one(4)
