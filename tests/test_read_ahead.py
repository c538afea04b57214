"""Fills that read ahead find the candidates of fills that read page by page."""

from newsloom.plans import catalogue, feed


def test_fills_equal_single_reads(spark):
    sf = "/root/testdata/sf0.001"
    news, vector, limits = catalogue._news(spark, sf), catalogue._query_vector(spark, sf), feed.fill_limits(20)
    interests, projects, cursor = ["the", "With"], ["tau", "nobody"], ""
    ahead = feed.ReadAhead(news, projects, interests, cursor)
    seen = lambda rows: sorted((r["id"], r["route"], r["ord"], r["semantic_match_score"], r["event_type"]) for r in rows.collect())
    for _ in range(2):
        found, onward = ahead.recalled(vector, limits, cursor)
        assert seen(found) == seen(news.recalled(interests, projects, vector, limits, cursor))
        assert onward == feed._last_cursor(news.feed.latest(limits["latest"], cursor), limits["latest"]) != ""
        cursor = onward
    later = feed.ReadAhead(news, projects, interests, cursor)  # a session that goes on in another call
    assert seen(later.recalled(vector, limits, cursor)[0]) == seen(news.recalled(interests, projects, vector, limits, cursor))


def test_source_ends(spark):
    news = catalogue._news(spark, "/root/testdata/sf0.001")
    ahead, cursor, read = feed.ReadAhead(news, [], [], ""), "", 0
    limits = feed.fill_limits(20) | {"latest": 30}
    while True:
        _, onward = ahead.recalled(None, limits, cursor)
        read += 1
        if not onward:
            break
        cursor = onward
    assert read == 7 and len(ahead.latest) == 200  # 200 documents, 30 a page
