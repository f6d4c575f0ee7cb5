from leadloom.operators import taxonomy


def test_terms_are_joined_once_an_occupation(spark):
    """Industries and terms of one occupation are not multiplied: both sides are aggregated before they meet."""
    ours = [(f"n{i % 3}", "Retail", f"{20 + i % 2}-1", i) for i in range(40)] + [("n0", "Other", "20-1", 0), ("n0", "Retail", "11-1", 0)]
    terms = [(f"{20 + i % 2}-1", f"Maker {'ABCDEFG'[i % 7]}", i % 6) for i in range(60)] + [("11-1", "Maker Z", 0), ("20-1", "Maker, Y", 0)]
    out = taxonomy.suggest_terms("Retail", spark.createDataFrame(ours, "naics3 string, client_industry string, soc_code string, rank int"), spark.createDataFrame(terms, "soc_code string, search_term string, rank int"), excluded=["11-0000"])
    best = {}
    for n, sector, soc, place in ours:
        for code, term, rank in terms:
            if sector == "Retail" and soc == code and soc[:2] not in ("11", "15") and rank <= 5 and "," not in term:
                best[term] = min(best.get(term, ("~",)), (n, place, soc, rank))
    assert [r.search_term for r in out.orderBy("place").collect()] == sorted(best, key=lambda t: (best[t], t))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Join Inner") :].count("Aggregate") == 2
