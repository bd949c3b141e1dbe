"""The flagship: raw listings to the stored table, reported by brand."""

from __future__ import annotations

from loomline.operators import cleaning, reports
from loomline.plans.cleaning import FIRST, cleaned_once
from loomline.plans.fixtures import CLEAN_SQL, FIRST_SEEN
from loomline.sources import tables


BRAND_SEEN = FIRST_SEEN[:4]  # as far as the brand of the first row depends on it


def flagship(spark, sf_dir):
    rows = cleaning.outliers_removed(cleaned_once(spark, sf_dir, ["url", *BRAND_SEEN]))
    stored = tables.insert_if_absent(rows, None, BRAND_SEEN)
    return reports.brand_counts(stored)


QUERIES = {"flagship": flagship}

ORACLE = {
    "flagship": f"""WITH {CLEAN_SQL},
        M AS (SELECT brand AS b, quantile_disc(price, 0.5) AS m FROM C GROUP BY brand),
        K AS (SELECT C.* FROM C JOIN M ON brand = b WHERE price < m * 10 QUALIFY {FIRST})
        SELECT brand, count(*) AS n FROM K GROUP BY brand""",
}
