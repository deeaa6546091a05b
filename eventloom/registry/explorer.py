"""Historical explorer over all five datasets."""

from __future__ import annotations

from eventloom.plans import explorer
from eventloom.registry import query
from eventloom.registry.views import archive, catalog, marketplace, plain, samples, uplift_users, with_sql


def _register(name, view, chart, sql, drop=(), **filters):
    dataset = name.split("_")[0]

    def run(spark, sf_dir):
        return plain(explorer.historical(dataset, view(spark, sf_dir), **filters)[chart].drop(*drop))

    query(f"explorer_{name}", sql)(run)


_TOP = "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT"

_A = with_sql("archive")
_register("otto_metrics", archive, "metrics", _A + "SELECT count(*) AS events FROM archive", drop=["sessions_approx"])
_register("otto_daily", archive, "daily", _A + """SELECT strftime(event_time, '%Y-%m-%d') AS label, event_type AS series, count(*) AS value
    FROM archive GROUP BY ALL""")
_register("otto_actions", archive, "actions", _A + "SELECT event_type AS label, count(*) AS value FROM archive GROUP BY 1")
_register("otto_articles", archive, "articles", _A + f"SELECT CAST(article_id AS VARCHAR) AS label, count(*) AS value FROM archive {_TOP} 10")

_M = with_sql("market")
_register("rees46_metrics", marketplace, "metrics", _M + "SELECT count(*) AS events FROM market", drop=["users_approx"])
_register("rees46_monthly", marketplace, "monthly", _M + """SELECT strftime(event_date, '%Y%m') AS label, event_type AS series, count(*) AS value
    FROM market GROUP BY ALL""")
_register("rees46_categories", marketplace, "categories", _M + f"""SELECT category_code AS label, count(*) FILTER (WHERE event_type = 'view') AS value
    FROM market WHERE category_code <> '' {_TOP} 10""")
_register("rees46_brands", marketplace, "brands", _M + f"SELECT brand AS label, count(*) AS value FROM market WHERE brand <> '' {_TOP} 10")

_S = with_sql("samples")
_register("eleme_metrics", samples, "metrics", _S + "SELECT count(*) AS samples, CAST(sum(clicked) AS BIGINT) AS positive_labels FROM samples", drop=["users_approx"])
_register("eleme_days", samples, "days", _S + "SELECT CAST(sample_day AS VARCHAR) AS label, count(*) AS value FROM samples GROUP BY 1")
_register("eleme_hours", samples, "hours", _S + "SELECT CAST(request_hour AS VARCHAR) AS label, count(*) AS value FROM samples GROUP BY 1")
_register("eleme_meals", samples, "meals", _S + "SELECT meal_period AS label, CAST(sum(clicked) AS BIGINT) AS value FROM samples GROUP BY 1")
_register("eleme_hours_one_day", samples, "hours", _S + """SELECT CAST(request_hour AS VARCHAR) AS label, count(*) AS value FROM samples
    WHERE sample_day = 3 GROUP BY 1""", period="3")

_C = with_sql("catalog")
_register("glovo_metrics", catalog, "metrics", _C + """SELECT count(*) AS products, count(DISTINCT store_name) AS store_names,
    count(DISTINCT row(country_code, city_code)) AS cities FROM catalog""", country="ALL")
_register("glovo_cities", catalog, "cities", _C + f"SELECT country_code || '/' || city_code AS label, count(*) AS value FROM catalog {_TOP} 12", country="ALL")
_register("glovo_sections", catalog, "sections", _C + f"""SELECT collection_section AS label, count(*) AS value FROM catalog
    WHERE collection_section <> '' {_TOP} 12""", country="ALL")
_register("glovo_stores", catalog, "stores", _C + f"SELECT store_name AS label, count(*) AS value FROM catalog {_TOP} 12", country="ALL")
_register("glovo_one_country", catalog, "metrics", _C + """SELECT count(*) AS products, count(DISTINCT store_name) AS store_names,
    count(DISTINCT row(country_code, city_code)) AS cities FROM catalog WHERE country_code = 'EU'""", country="EU")

_U = with_sql("users")
_register("criteo_metrics", uplift_users, "metrics", _U + """SELECT count(*) AS users, CAST(sum(visit) AS BIGINT) AS visits,
    CAST(sum(conversion) AS BIGINT) AS purchases FROM users""")
_register("criteo_groups", uplift_users, "groups", _U + """SELECT CASE WHEN treatment = 1 THEN 'Treatment' ELSE 'Control' END AS label, count(*) AS users,
    round(avg(visit) * 100, 6) AS visit_pct, round(avg(conversion) * 100, 6) AS purchase_pct FROM users GROUP BY 1""")


@query("dataset_summary_arms", _U + """SELECT treatment::BIGINT AS treatment, count(*) AS users, round(avg(exposure), 6) AS exposure_rate, round(avg(visit), 6) AS visit_rate,
    round(avg(conversion), 6) AS conversion_rate FROM users GROUP BY 1""")
def summary_arms(spark, sf_dir):
    return plain(explorer.dataset_summaries(uplift_users(spark, sf_dir), None)["criteo"])


@query("dataset_summary_countries", _C + """SELECT country_code, count(*) AS products, count(DISTINCT store_name) AS stores,
    count(*) FILTER (WHERE city_code = 'MAD') AS madrid_products FROM catalog GROUP BY 1""")
def summary_countries(spark, sf_dir):
    return plain(explorer.dataset_summaries(None, catalog(spark, sf_dir))["glovo"])
