"""Every operator on awkward and on empty tables."""

import pytest
from pyspark.sql import functions as F

from postmill.llm import chosen_path, decontaminate, fingerprint, langid, licences, pii, secret_scan, soft_mixing, suffix_tree, zip_warc


def _language(spark, d):
    return langid.identify(d, langid.fit_text_model(d), "doc_id", "text", declared=F.col("lang"), host=F.col("source"))


def _warc(spark, d):
    from postmill.llm.shared import new_path

    return zip_warc.read_packages(zip_warc.write_packages(d, new_path(spark, "w"), "doc_id", "source", "text"))


def _mix(spark, d):
    return soft_mixing.mix_to_targets(d, d.select("doc_id", F.lit("high").alias("domain"))).drop("text")


OPERATORS = {
    "language": _language, "fingerprints": lambda s, d: fingerprint.fingerprints_with_neighbours(d), "lm": lambda s, d: suffix_tree.score(d, suffix_tree.fit(d)),
    "licences": lambda s, d: licences.scan_licences(d, licences.known_licences(s)), "contamination": lambda s, d: decontaminate.contamination(d, d.where("doc_id < 7").select(F.col("doc_id").alias("item_id"), "text")),
    "jaccard": lambda s, d: chosen_path.jaccard_classes(d), "pii": lambda s, d: pii.find_personal_data(d), "secrets": lambda s, d: secret_scan.find_secrets(d), "warc": _warc, "mixing": _mix,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_each_have_a_result(spark, awkward, name):
    rows = OPERATORS[name](spark, awkward).collect()
    assert len(rows) == awkward.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(spark, nothing, name):
    assert OPERATORS[name](spark, nothing).count() == 0


def test_clean_and_repeated_rows_of_the_awkward_table(spark, awkward):
    got = {r["doc_id"]: r for r in chosen_path.jaccard_classes(awkward).collect()}
    assert got[1]["class_id"] == got[2]["class_id"] == got[3]["class_id"] == 1 and got[8]["n_copies"] == 2 and got[10]["class_id"] == 7
    assert all(got[k]["class_id"] == k and got[k]["n_links"] == 0 for k in (4, 5, 6, 9))


def _by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_licences_of_the_awkward_table(spark, awkward):
    got = _by_id(licences.scan_licences(awkward, licences.known_licences(spark)).collect())
    assert all(r["licence"] is None for rows in got.values() for r in rows) and [r["canonical_chars"] for r in got[4] + got[5] + got[6] + got[11]] == [0, 0, 0, 0]
    assert len(got[8]) == 2 and got[8][0] == got[8][1] and len(got[None]) == 1 and got[7][0]["canonical_chars"] > 300_000


def test_contamination_of_the_awkward_table(spark, awkward):
    got = _by_id(OPERATORS["contamination"](spark, awkward).collect())
    assert [got[k][0]["n_items"] for k in (1, 2, 3, 4, 5, 6, 10)] == [3, 3, 3, 0, 0, 0, 0] and got[1][0]["n_hit"] == got[1][0]["n_words"] and got[None][0]["n_words"] == 3


def test_personal_data_and_secrets_of_the_awkward_table(spark, awkward):
    for found in (pii.find_personal_data(awkward), secret_scan.find_secrets(awkward)):
        rows = found.collect()
        assert all(r["spans"] == r["base_spans"] == "" for r in rows)


def test_scores_of_the_awkward_table(spark, awkward):
    got = _by_id(OPERATORS["lm"](spark, awkward).collect())
    # an end only, whatever is missing; repeated rows alike; the row without an id is scored
    assert [got[k][0]["n_tokens"] for k in (4, 5)] == [1, 1] and got[4][0]["score"] == got[5][0]["score"] and got[8][0] == got[8][1] and got[None][0]["n_tokens"] == 4
    assert got[7][0]["n_tokens"] == 120_001 and all(r["n_known"] == r["n_tokens"] for rows in got.values() for r in rows)


def test_languages_of_the_awkward_table(spark, awkward):
    got = _by_id(OPERATORS["language"](spark, awkward).collect())
    assert all(got[k][0]["rejected"] and got[k][0]["n_grams"] == 0 for k in (4, 5, 6, 11)) and got[9][0]["lang"] == "fr" and got[7][0]["lang"] == "en" and len(got[8]) == 2


def test_fingerprints_of_the_awkward_table(spark, awkward):
    got = _by_id(OPERATORS["fingerprints"](spark, awkward).collect())
    assert got[4][0]["fingerprint"] == got[5][0]["fingerprint"] == "4::" and got[1][0]["fingerprint"] == got[2][0]["fingerprint"] and got[8][0]["fingerprint"] == got[8][1]["fingerprint"]
    assert got[7][0]["n_chars"] == awkward.where("doc_id = 7").first()["n_chars"] and got[1][0]["near_next"] == 1


def test_records_of_the_awkward_table(spark, awkward):
    got = OPERATORS["warc"](spark, awkward).collect()
    assert sorted(r["page"] or "" for r in got) == sorted("" if r["doc_id"] is None else str(r["doc_id"]) for r in awkward.select("doc_id").collect())
    assert all(r["record_type"] == "response" for r in got) and {r["payload_bytes"] for r in got if r["page"] in ("4", "5")} == {0}


def test_mixing_of_the_awkward_table_keeps_its_columns(spark, awkward):
    out = OPERATORS["mixing"](spark, awkward)
    assert {"rate", "rate_in", "n_tokens", "key", "share"} <= set(out.columns) and {r["rate_in"] for r in out.select("rate_in").collect()} == {"q"}
    got = _by_id(out.collect())
    assert [got[k][0]["n_tokens"] for k in (4, 5, 6)] == [0, 0, 0] and got[8][0] == got[8][1] and len(got[None]) == 1
