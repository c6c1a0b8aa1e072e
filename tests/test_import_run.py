"""One import run: its totals, its sinks, and what a second run changes."""

import json

import pytest

from tessella.plans import import_run as R

KIND = "row_number long, url string, citation string, full_text string, html string, file_path string, file_text string, language string, judgment_date string, error string"


def url(i, day="2020-01-01"):
    return f"https://host/akn/gh/judgment/ghasc/2020/{i}/eng@{day}"


def text(i):
    return f"Judgment number {i}. " + " ".join(f"word{i}x{k}" for k in range(40))


def row(i, **other):
    made = dict(row_number=i, url=url(i), citation=f"Party{i} v. Other{i} [2020] GHASC {i}", full_text=text(i), html=None, file_path=f"f{i}.pdf", file_text=f"cover page {text(i)}", language="en", judgment_date="17 June 1963", error=None) | other
    return tuple(made[c.split()[0]] for c in KIND.split(", "))


@pytest.fixture(scope="module")
def export():
    """A hundred rows: 92 accepted, 6 quarantined, 2 skipped."""
    rows = [row(i) for i in range(84)]
    rows += [row(84, file_text="quite another text of the same length or so"), row(85, file_text="wholly different")]  # mismatches
    rows += [row(86, file_text=None)]  # missing
    rows += [row(87, judgment_date="on a Monday")]
    rows += [row(88, full_text=text(900), file_text=text(900)), row(89, full_text=text(900), file_text=text(900))]  # one text, two addresses
    rows += [row(90, full_text=" N/A ", file_text=""), row(91, full_text=None, file_path=None, file_text=None, html="<p>x")]
    rows += [row(92, full_text=None, file_path=None), row(93, full_text="", file_path="lost.pdf", file_text=None), row(94, full_text=None, file_path=None, file_text=None)]  # nothing usable
    rows += [row(95, url="https://host/other/95"), row(96), row(97, url=url(96), full_text=text(97))]  # no address, conflict
    rows += [row(98, **dict(zip([c.split()[0] for c in KIND.split(", ")], row(0))) | {"row_number": 98}), row(99, **dict(zip([c.split()[0] for c in KIND.split(", ")], row(1))) | {"row_number": 99})]
    assert len(rows) == 100
    return rows


def test_totals_of_a_dry_run(spark, export):
    r = R.run_import(spark.createDataFrame(export, KIND).repartition(5), dry_run=True)
    assert (r.rows_read, r.accepted, r.quarantined, r.skipped_duplicate, r.failed) == (100, 92, 6, 2, 0)
    assert r.reasons == {"invalid_uri": 1, "duplicate_uri_conflict": 2, "no_text_and_no_file": 3}
    assert r.warnings == {"duplicate_uri_identical": 2, "file_mismatch": 2, "file_missing": 2, "unparsed_date": 1, "shared_text": 2}
    assert (r.text_available, r.ocr_pending, r.conversion_pending) == (90, 1, 1)
    assert r.files == {"verified": 87, "mismatch": 2, "missing": 2, "unverified": 1} and (r.inserted, r.updated) == (95, 0)
    again = R.run_import(spark.createDataFrame(export, KIND).repartition(3), dry_run=True)
    assert again == r


def test_limit_takes_the_first_rows(spark, export):
    r = R.run_import(spark.createDataFrame(export, KIND).repartition(4), dry_run=True, limit=86)
    assert (r.rows_read, r.accepted, r.warnings) == (86, 86, {"file_mismatch": 2})


def test_a_broken_row_does_not_end_the_run(spark, export):
    rows = [*export[:5], row(5, error="ValueError: broken")]
    to = R.shared_path(spark, "import-test")
    r = R.run_import(spark.createDataFrame(rows, KIND), to=to)
    assert (r.failed, r.accepted, r.reasons) == (1, 5, {"prepare_failed": 1})
    assert [tuple(x) for x in spark.read.parquet(f"{to}/issues").select("row_number", "severity", "reason", "detail").collect()] == [(5, "quarantine", "prepare_failed", "ValueError: broken")]


def test_sinks_and_a_second_run(spark, export):
    first, second, third = (R.shared_path(spark, "import-test") for _ in range(3))
    rows = spark.createDataFrame(export, KIND)
    r = R.run_import(rows, to=first)
    stored = spark.read.parquet(f"{first}/stored")
    assert stored.count() == 95 == r.inserted and stored.where("status = 'quarantined'").count() == 3
    assert spark.read.parquet(f"{first}/issues").count() == 6 + sum(r.warnings.values())
    assert json.loads(spark.read.text(f"{first}/report").first()[0])["accepted"] == 92
    again = R.run_import(rows, stored, to=second)
    assert (again.inserted, again.updated, again.skipped_unchanged) == (0, 0, 95)
    key = ["uri", "status", "record_hash"]
    assert sorted(map(tuple, spark.read.parquet(f"{second}/stored").select(key).collect())) == sorted(map(tuple, stored.select(key).collect()))
    # An address that comes into conflict is set aside; another that changes is updated; what isn't in the export stays.
    changed = [export[0][:3] + ("A new text of some length.",) + export[0][4:], row(1), row(500, url=url(1))]
    last = R.run_import(spark.createDataFrame(changed, KIND), spark.read.parquet(f"{second}/stored"), to=third)
    assert (last.updated, last.inserted, last.reasons) == (1, 0, {"duplicate_uri_conflict": 2})
    state = {r.uri.split("/")[-2]: r.status for r in spark.read.parquet(f"{third}/stored").collect()}
    assert len(state) == 95 and state["1"] == "quarantined" and state["0"] == "eligible"
    back = R.run_import(rows.where("row_number = 1"), spark.read.parquet(f"{third}/stored"), dry_run=True)
    assert back.updated == 1
    assert R.run_import(rows.where("false"), dry_run=True).rows_read == 0
