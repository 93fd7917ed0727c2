"""Tables, enumerations and dictionaries."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations in their order.
COUNTRIES = ("KR", "US", "JP", "CN", "GB", "DE", "FR", "AU")
LEANINGS = ("CONSERVATIVE", "PROGRESSIVE")
CATEGORIES = ("WORLD",)
TOPIC_STATUSES = ("PENDING", "ACTIVE", "ARCHIVED")
RUN_STATUSES = ("RUNNING", "SUCCESS", "PARTIAL_FAILED", "FAILED")
STEPS = ("RSS_COLLECT", "ARTICLE_SAVE", "TOPIC_CLUSTERING", "AI_SUMMARY", "COMPLETED")
DUPLICATE_REASONS = ("RSS_GUID", "NORMALIZED_URL", "DEDUPE_KEY")

# The feeds (code, publisher, country, leaning, category, address).
FEEDS = (
    ("FOX_WORLD", "Fox News", "US", "CONSERVATIVE", "WORLD", "https://moxie.foxnews.com/google-publisher/world.xml"),
    ("NYT_WORLD", "New York Times", "US", "PROGRESSIVE", "WORLD", "https://rss.nytimes.com/services/xml/rss/nyt/World.xml"),
    ("CHOSUN_WORLD", "Chosun Ilbo", "KR", "CONSERVATIVE", "WORLD", "https://www.chosun.com/arc/outboundfeeds/rss/category/international/?outputType=xml"),
    ("HANI_WORLD", "Hankyoreh", "KR", "PROGRESSIVE", "WORLD", "https://www.hani.co.kr/rss/international"),
)


def _struct(spec: str) -> T.StructType:
    """``name TYPE`` or ``name! TYPE`` (not null), comma-separated."""
    kinds = {"LONG": T.LongType(), "INT": T.IntegerType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "TIME": T.TimestampNTZType(), "DATE": T.DateType()}
    fields = [f.split() for f in spec.split(",")]
    return T.StructType([T.StructField(n.rstrip("!"), kinds[k], not n.endswith("!")) for n, k in fields])


TABLES = {
    "publisher": _struct("id! LONG, name! STRING, country! STRING, political_leaning! STRING, rss_url STRING, created_at! TIME"),
    "publisher_feed": _struct("id! LONG, publisher_id! LONG, article_category! STRING, rss_url! STRING, active! BOOLEAN"),
    "article": _struct(
        "id! LONG, headline! STRING, normalized_headline! STRING, url! STRING, normalized_url! STRING, description STRING, published_at TIME, "
        "publisher_id! LONG, category! STRING, rss_guid STRING, dedupe_key! STRING, fetched_at! TIME"
    ),
    "topic": _struct(
        "id! LONG, title! STRING, summary STRING, ai_summary STRING, summary_generated_at TIME, ai_model STRING, article_category! STRING, "
        "status! STRING, start_date DATE, created_at! TIME"
    ),
    "topic_article": _struct("id! LONG, topic_id! LONG, article_id! LONG, linked_at! TIME"),
    "pipeline_run": _struct(
        "id! LONG, status! STRING, fetched_count! INT, saved_count! INT, clustered_count! INT, summarized_count! INT, message STRING, "
        "error_message STRING, started_at! TIME, finished_at TIME"
    ),
    "pipeline_step_history": _struct(
        "id! LONG, pipeline_run_id! LONG, step! STRING, status! STRING, target_type STRING, target_name STRING, processed_count! INT, "
        "success_count! INT, failed_count! INT, error_type STRING, error_message STRING, message STRING, started_at! TIME, finished_at TIME"
    ),
    "search_gram": _struct("version! INT, part! INT, gram! STRING, block! LONG, bits! LONG"),
    "daily_count": _struct("source! STRING, version! INT, part! INT, day! DATE, name STRING, n! LONG, at_midnight! LONG"),
}

CANDIDATE = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("publisherCode", "publisherName", "country", "politicalLeaning", "category", "headline", "url", "description", "rssGuid")],
    T.StructField("publishedAt", T.TimestampNTZType()),
])
FEED_ERROR = T.StructType([T.StructField(n, T.StringType()) for n in ("feedSourceCode", "publisherName", "errorType", "errorMessage")])
BATCH = T.StructType([T.StructField("articles", T.ArrayType(CANDIDATE)), T.StructField("feedErrors", T.ArrayType(FEED_ERROR))])

# Query parameters dropped from addresses.
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "ref", "source")

# English names → canonical token.
ENGLISH_ALIAS = {
    "trump": "donald_trump",
    "us": "united_states", "usa": "united_states", "america": "united_states", "american": "united_states", "americans": "united_states",
    "beijing": "china", "chinese": "china",
    "uk": "united_kingdom", "britain": "united_kingdom", "british": "united_kingdom",
    "eu": "european_union", "europe": "european_union", "european": "european_union",
}
# Korean names → canonical token.
KOREAN_ALIAS = {
    "트럼프": "donald_trump", "네타냐후": "netanyahu", "푸틴": "putin", "밴스": "vance", "젤렌스키": "zelensky", "시진핑": "xi_jinping",
    "왕이": "wang_yi", "하메네이": "khamenei", "모즈타바": "mojtaba", "이란": "iran", "레바논": "lebanon", "이스라엘": "israel", "나토": "nato",
    "우크라이나": "ukraine", "파키스탄": "pakistan", "북한": "north_korea", "대만": "taiwan", "러시아": "russia", "오만": "oman", "헝가리": "hungary",
    "헤즈볼라": "hezbollah", "백악관": "white_house", "연준": "federal_reserve", "휴전": "cease_fire", "호르무즈": "hormuz", "통행료": "toll",
    "해협": "strait", "우라늄": "uranium", "핵": "nuclear", "공습": "airstrike", "폭격": "airstrike", "협상": "negotiation", "제재": "sanction",
    "증시": "stock_market", "관세": "tariff",
}
# Particles in match order.
PARTICLES = (
    "에서", "으로", "까지", "부터", "에게", "한테", "께서", "이라", "라는", "이란", "라며", "이며", "이고", "라고", "이가", "이는", "이를", "이의", "이나", "라도", "으로", "로서",
    "에서", "에서의", "이서", "은", "는", "이", "가", "을", "를", "의", "에", "로", "와", "과", "도", "만", "서",
)
# Word pairs that make one token.
BIGRAMS = (
    ("trade", "war"), ("trade", "deal"), ("trade", "deficit"), ("trade", "policy"), ("interest", "rate"), ("interest", "rates"),
    ("stock", "market"), ("white", "house"), ("supply", "chain"), ("south", "korea"), ("north", "korea"), ("federal", "reserve"),
    ("wall", "street"), ("cease", "fire"),
)
# Tokens that anchor a story.
ANCHORS = (
    "netanyahu", "putin", "zelensky", "xi_jinping", "wang_yi", "khamenei", "mojtaba", "vance", "iran", "israel", "lebanon", "ukraine",
    "north_korea", "hezbollah", "pakistan", "russia", "taiwan", "oman", "hungary", "hormuz", "uranium",
)
# Stems put right afterwards.
POST_STEM = {"impos": "impose"}
