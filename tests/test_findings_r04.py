"""Cases of the fourth round's finding: texts that redaction is for, which the stored tables lack."""

from __future__ import annotations

from hashlib import md5

import duckdb

from recollect.plans import registry

from .test_findings_r03 import same

GITHUB, JWT, AWS = "ghp_" + "a1B2" * 9, "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + ".c_-", "AKIA" + "A" * 16
# text, redacted text, hits
CASES = [
    ("fine", "fine", 0),
    ("", "", 0),
    (None, None, None),
    (f"{AWS} and password: 12345678", "[REDACTED] and [REDACTED]", 2),
    (f"push with {GITHUB}, {GITHUB} and github_pat_" + "x" * 82, "push with [REDACTED], [REDACTED] and [REDACTED]", 3),
    (f"cookie {JWT}\n{JWT}", "cookie [REDACTED]\n[REDACTED]", 2),
    ("curl -H 'Authorization: Bearer abc' -H 'authorization:bearer\tdef'", "curl -H '[REDACTED] -H '[REDACTED]", 2),
    ("-----BEGIN RSA PRIVATE KEY-----\nMII", "[REDACTED]\nMII", 1),
    (f"access_token={GITHUB} {AWS} Authorization: Bearer {JWT}", "[REDACTED] [REDACTED] [REDACTED]", 5),  # a rule counts what earlier ones left
    (f"password={AWS} auth-token = {JWT}", "[REDACTED] [REDACTED]", 3),
    ("the ghp_ prefix, an eyJ, a PRIVATE KEY and a bearer of news", "the ghp_ prefix, an eyJ, a PRIVATE KEY and a bearer of news", 0),
]


def test_texts_with_secrets_are_redacted_and_counted(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table d (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into d values (?, ?, 'en', 's')", [(k, case[0]) for k, case in enumerate(CASES)])
    con.execute(f"copy d to '{tmp_path}/documents.parquet'")
    got = {r.id: (r.digest, r.hits) for r in registry.queries()["h2_redact_counted"](spark, str(tmp_path)).collect()}
    assert got == {k: (None if left is None else md5(left.encode()).hexdigest(), hits) for k, (_, left, hits) in enumerate(CASES)}
    same(spark, tmp_path, "h2_redact_counted", ["documents"])
