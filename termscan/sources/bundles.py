"""Compile bundles: the results and the pattern database in one zip, or as a folder of tables."""

from __future__ import annotations

import io
import json
import re
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscan.operators.compile import FLAG_NAMES, pattern_set

from .pattern_files import write_head


def bundle(results: DataFrame, rule: str) -> tuple[str, bytes]:
    """The zip's name and bytes: results as JSON, and the database or a note that there is none. For one request's terms."""
    safe = re.sub(r"[^a-zA-Z0-9._-]", "_", rule) if (rule or "").strip() else "lexicon_rule"
    rows = [r.asDict() for r in results.orderBy("position").collect()]
    passed = [r for r in rows if r["status"] == "PASS"]
    report = {"lexiconRuleName": rule, "totalTerms": len(rows), "passCount": len(passed), "failedCount": len(rows) - len(passed), "results": [{k: v for k, v in r.items() if v is not None} for r in rows]}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"{safe}-compile-results.json", json.dumps(report, ensure_ascii=False, indent=1))
        if passed:
            z.writestr(f"{safe}.hdb", write_head([(r["position"], r["pattern"], [b for b in FLAG_NAMES if r["flags"] & b]) for r in passed]))
        else:
            z.writestr("NO_DATABASE.txt", "No term compiled, so there is no database.\n")
    return f"{safe}-compile-bundle.zip", out.getvalue()


def write_bundle(results: DataFrame, path: str) -> None:
    """The same for lexicons of any size: folders results (JSON) and patterns (Parquet)."""
    results.write.mode("overwrite").json(f"{path}/results")
    pattern_set(results).write.mode("overwrite").parquet(f"{path}/patterns")


def read_patterns(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/patterns").orderBy(F.col("id"))
