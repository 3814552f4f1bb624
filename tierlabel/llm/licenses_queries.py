from __future__ import annotations

from tierlabel.llm.common import table
from tierlabel.llm.licenses import scan_licenses
from tierlabel.llm.registry import query


@query("op3_license_scan")
def op3(spark, folder):
    return scan_licenses(table(spark, folder, "documents"))
