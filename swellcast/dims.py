"""Enumerations, parameter dimensions and rule thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: candidate types, kinds, families, roles, lanes --------------------

CANDIDATE_TYPES = (
    "PERSON", "GROUP", "MUSIC_ARTIST", "MUSIC_TRACK", "WORK", "SHOW", "REALITY_SHOW",
    "PHRASE", "HASHTAG", "BEHAVIOR", "STYLE", "PRODUCT", "BRAND", "KEYWORD",
)
TOPIC_TYPES = ("PHRASE", "HASHTAG", "BEHAVIOR", "STYLE", "PRODUCT", "KEYWORD")
PERSON_TYPES = ("PERSON", "GROUP", "MUSIC_ARTIST")
WORK_TYPES = ("WORK", "SHOW", "REALITY_SHOW")
CHART_TYPES = ("MUSIC_ARTIST", "MUSIC_TRACK", "SHOW", "REALITY_SHOW", "WORK")
CONTEXT_TYPES = (
    "PERSON", "GROUP", "MUSIC_ARTIST", "MUSIC_TRACK", "WORK", "SHOW", "REALITY_SHOW",
    "PRODUCT", "BRAND",
)
MATURE_TYPES = ("PERSON", "GROUP", "MUSIC_ARTIST", "MUSIC_TRACK")
FAMILIES = (
    "SEARCH", "SOCIAL_DISCOVERY", "MUSIC_CHART", "SHOW_CHART", "FASHION_STYLE", "COMMERCE",
    "EDITORIAL", "REFERENCE", "VIDEO_CONFIRM", "AD_COMMERCE_AUX", "UNKNOWN",
)
ROLES = ("DISCOVERY", "CONFIRMATION", "EDITORIAL", "COMMERCE", "REFERENCE", "EVIDENCE_ONLY")
SUPPORT_ROLES = ("CONFIRMATION", "EDITORIAL", "COMMERCE")
DOMAINS = (
    "ENTERTAINMENT", "FASHION_BEAUTY", "CONSUMER_CULTURE", "GENERAL_NEWS",
    "BUSINESS_PROFESSIONAL", "OTHER",
)
MAIN_DOMAINS = ("ENTERTAINMENT", "FASHION_BEAUTY", "CONSUMER_CULTURE")
LANES = ("people_music", "shows_formats", "words_behaviors", "style_products", "shadow")
TARGET_LANES = LANES[:4]
LANE_BY_TYPE = {
    "PERSON": "people_music", "GROUP": "people_music", "MUSIC_ARTIST": "people_music",
    "MUSIC_TRACK": "people_music",
    "WORK": "shows_formats", "SHOW": "shows_formats", "REALITY_SHOW": "shows_formats",
    "PHRASE": "words_behaviors", "HASHTAG": "words_behaviors", "BEHAVIOR": "words_behaviors",
    "KEYWORD": "words_behaviors",
    "STYLE": "style_products", "PRODUCT": "style_products", "BRAND": "style_products",
}
CONFIDENCE_WEIGHT = {"HIGH": 1.0, "MEDIUM": 0.7, "LOW": 0.4}
CONFIDENCE_RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}
HOME_COUNTRY = "JP"
ASIA_COUNTRIES = ("JP", "KR", "TW", "HK", "TH", "VN", "ID", "PH", "MY", "SG")

# --- Fixed values: anomaly parameters per family --------------------------------------


@dataclass(frozen=True)
class FamilyParams:
    half_life_days: float
    warmup_days: int
    momentum_lambda: float


@dataclass(frozen=True)
class AlgorithmConfig:
    half_life_days: float = 7.0
    beta: float = 0.1
    warmup_days: int = 3
    min_sig: float = 2.0
    multi_weight: float = 1.0
    momentum_lambda: float = 0.7
    max_x_clip: float = 50.0
    gate_discovery_threshold: float = 0.55
    mass_heat_weight: float = 0.35
    source_weight_floor: float = 0.25
    family_params: dict[str, FamilyParams] = field(
        default_factory=lambda: {
            "SEARCH": FamilyParams(3.0, 1, 0.75),
            "SOCIAL_DISCOVERY": FamilyParams(3.0, 1, 0.75),
            "FASHION_STYLE": FamilyParams(4.0, 1, 0.75),
            "COMMERCE": FamilyParams(6.0, 2, 0.70),
            "MUSIC_CHART": FamilyParams(7.0, 2, 0.70),
            "SHOW_CHART": FamilyParams(10.0, 2, 0.80),
            "EDITORIAL": FamilyParams(5.0, 1, 0.65),
        }
    )

    def params_for(self, family: str) -> FamilyParams:
        default = FamilyParams(self.half_life_days, self.warmup_days, self.momentum_lambda)
        return self.family_params.get(family, default)


@dataclass(frozen=True)
class WeightingConfig:
    enabled: bool = True
    window_days: int = 30
    horizon_days: int = 7
    top_k_for_future: int = 20
    top_m_default: int = 20
    n_ref: int = 50
    i_min: float = 0.2
    s_min: float = 0.5
    epsilon: float = 1e-9


@dataclass(frozen=True)
class AppConfig:
    top_k: int = 20
    monthly_budget: int = 5000
    template_at_ratio: float = 0.6
    search_reduce_at_ratio: float = 0.8
    shadow_days: int = 14


@dataclass(frozen=True)
class MusicConfig:
    weights: dict[str, float] = field(
        default_factory=lambda: {"JP": 1.0, "KR": 0.85, "GLOBAL": 0.1}
    )


# --- Fixed values: candidate type x source family fit ----------------------------------

_BASE_FIT = {
    "PERSON": 0.2, "GROUP": 0.2, "MUSIC_ARTIST": 0.2,
    "MUSIC_TRACK": 0.0, "SHOW": 0.0, "REALITY_SHOW": 0.0,
    "PHRASE": 0.1, "HASHTAG": 0.1, "BEHAVIOR": 0.1, "STYLE": 0.1, "PRODUCT": 0.1,
    "BRAND": 0.1, "KEYWORD": 0.1,
}
_FIT_BY_GROUP = (
    (("PERSON", "GROUP", "MUSIC_ARTIST"),
     {"SEARCH": 1.0, "SOCIAL_DISCOVERY": 1.0, "MUSIC_CHART": 1.0, "SHOW_CHART": 0.5,
      "EDITORIAL": 0.8, "FASHION_STYLE": 0.4, "COMMERCE": 0.2}),
    (("MUSIC_TRACK",),
     {"SEARCH": 0.8, "SOCIAL_DISCOVERY": 0.8, "MUSIC_CHART": 1.0, "EDITORIAL": 0.4}),
    (("SHOW", "REALITY_SHOW", "WORK"),
     {"SEARCH": 1.0, "SOCIAL_DISCOVERY": 1.0, "SHOW_CHART": 1.0, "EDITORIAL": 0.8,
      "FASHION_STYLE": 0.2}),
    (("PHRASE", "HASHTAG", "BEHAVIOR", "KEYWORD"),
     {"SEARCH": 1.0, "SOCIAL_DISCOVERY": 1.0, "FASHION_STYLE": 0.8, "EDITORIAL": 0.6,
      "COMMERCE": 0.6, "SHOW_CHART": 0.3, "MUSIC_CHART": 0.1}),
    (("STYLE", "PRODUCT", "BRAND"),
     {"SEARCH": 0.8, "SOCIAL_DISCOVERY": 0.8, "FASHION_STYLE": 1.0, "EDITORIAL": 0.7,
      "COMMERCE": 1.0}),
)


def domain_fit_rows() -> list[tuple[str, str, float]]:
    """The fit matrix as (type, family, fit) rows; absent pairs mean 0."""
    fit = {(t, f): base for t, base in _BASE_FIT.items() for f in FAMILIES}
    for types, values in _FIT_BY_GROUP:
        for t in types:
            fit.update({(t, f): v for f, v in values.items()})
    return [(t, f, v) for (t, f), v in sorted(fit.items())]


# --- Fixed values: rule thresholds ------------------------------------------------------

RULES = {
    "topic_single_family_public_threshold": 0.78,
    "topic_multi_family_public_threshold": 0.52,
    "relation_only_public_threshold": 0.60,
    "low_value_penalty_block_threshold": 0.70,
    "credible_words_behaviors_min": 1,
    "single_family_dominance_max": 0.45,
    "public_rankability_min": 0.50,
    "capped_relation_support": 0.18,
    "work_cluster_cap_small": 1,
    "work_cluster_cap_small_direct": 2,
    "work_cluster_cap_large": 2,
    "work_cluster_cap_large_direct": 3,
    "short_video_song_threshold": 0.62,
    "short_video_topic_threshold": 0.70,
    "short_video_video_threshold": 0.74,
    "short_video_hashtag_region_min": 1.6,
    "short_video_video_region_min": 2.6,
    "short_video_topic_noise_max": 0.40,
    "short_video_video_noise_max": 0.34,
    "short_video_song_credibility_min": 0.08,
    "short_video_topic_credibility_min": 0.08,
    "short_video_video_credibility_min": 0.10,
    "short_video_creator_credibility_min": 0.12,
}
RELATION_WEIGHTS = {
    "features_in": 0.55, "voice_acts_in": 0.45, "theme_song_of_exact": 0.50,
    "theme_song_of_fuzzy": 0.35, "appears_in_reality_show": 0.60, "associated_with_work": 0.35,
}
PROPAGATING_RELATIONS = (
    "features_in", "voice_acts_in", "theme_song_of", "appears_in_reality_show",
    "associated_with_work",
)
SOFT_QUOTA = {
    "people_music_max_ratio": 0.45,
    "shows_formats_target_ratio": 0.2,
    "words_behaviors_min_ratio": 0.2,
    "style_products_min_ratio": 0.15,
}

# --- Fixed values: source groups the rules refer to by id --------------------------------

SEARCH_ENT = "SEARCH_JP_24H_ENT"
SEARCH_BEAUTY = "SEARCH_JP_24H_BEAUTY_FASHION"
REALTIME = "YAHOO_REALTIME"
HOME_SOURCES = (
    SEARCH_ENT, SEARCH_BEAUTY, REALTIME, "APPLE_MUSIC_JP", "NETFLIX_TV_JP",
    "NETFLIX_FILMS_JP", "TVER_RANKING_JP", "YOUTUBE_TREND_JP",
)
STREAM_SOURCES = ("NETFLIX_TV_JP", "NETFLIX_FILMS_JP")
CATCHUP_SOURCES = ("TVER_RANKING_JP",)
SHORT_VIDEO_PREFIX = "TIKTOK_CREATIVE_CENTER"
SHORT_VIDEO_SOURCES = tuple(
    f"{SHORT_VIDEO_PREFIX}_{s}" for s in ("HASHTAGS", "SONGS", "CREATORS", "VIDEOS")
)
CREDIBILITY_SOURCES = (SEARCH_ENT, SEARCH_BEAUTY, REALTIME)
DIRECT_CHART_SOURCES = ("APPLE_MUSIC_JP", "YOUTUBE_TREND_JP")
UNWEIGHTED_SOURCES = ("WIKI_PAGEVIEWS", "X_SEARCH", "IG_BOOST")
SURFACE_WEIGHT = {"song": 1.15, "hashtag": 1.0, "video": 0.85, "creator": 0.65}
BUCKET_BY_SOURCE = {
    "YOUTUBE_TREND_JP": "YOUTUBE",
    "APPLE_MUSIC_JP": "MUSIC", "APPLE_MUSIC_KR": "MUSIC", "APPLE_MUSIC_GLOBAL": "MUSIC",
    "SEARCH": "SEARCH", "SEARCH_JP_24H_ENT": "SEARCH",
    "SEARCH_JP_24H_BEAUTY_FASHION": "SEARCH",
    "NEWS_RSS": "NEWS_RSS", "RAKUTEN_MAG": "MAGAZINES",
    "X_SEARCH": "X", "X_TRENDING": "X",
    "NETFLIX_TV_JP": "RANKINGS_STREAM", "NETFLIX_FILMS_JP": "RANKINGS_STREAM",
    "TVER_RANKING_JP": "RANKINGS_STREAM",
    "IG_BOOST": "INSTAGRAM_BOOST",
}
MUSIC_REGION_BY_SOURCE = {
    "APPLE_MUSIC_JP": "JP", "APPLE_MUSIC_KR": "KR", "APPLE_MUSIC_GLOBAL": "GLOBAL",
}
UNIT_COST = {"X_SEARCH": 5.0, "LLM_SUMMARY": 3.0, "LLM_RESOLUTION": 2.0}

# --- Fixed values: source catalog (id, role, primary family, secondary family,
#     status, access mode, credentials, phrases, entities, weight cap) --------------------

CATALOG = (
    ("SEARCH_RSS", "DISCOVERY", "SEARCH", "SOCIAL_DISCOVERY", "DISABLED", "RSS", False, True, True, 1.4),
    ("SEARCH_JP_24H_ENT", "DISCOVERY", "SEARCH", "SOCIAL_DISCOVERY", "CORE", "HTML", False, True, True, 1.45),
    ("SEARCH_JP_24H_BEAUTY_FASHION", "DISCOVERY", "SEARCH", "SOCIAL_DISCOVERY", "CORE", "HTML", False, True, True, 1.45),
    ("YAHOO_REALTIME", "DISCOVERY", "SOCIAL_DISCOVERY", "SEARCH", "CORE", "HTML", False, True, True, 1.35),
    ("WEAR_WORDS", "DISCOVERY", "FASHION_STYLE", "COMMERCE", "CORE", "HTML", False, True, True, 1.25),
    ("ZOZO_RANKING", "COMMERCE", "FASHION_STYLE", "COMMERCE", "CORE", "HTML", False, True, True, 1.1),
    ("RAKUTEN_FASHION", "COMMERCE", "COMMERCE", "FASHION_STYLE", "CORE", "HTML", False, True, True, 1.0),
    ("RAKUTEN_ICHIBA_RANKING", "COMMERCE", "COMMERCE", "FASHION_STYLE", "EXPERIMENTAL", "API", True, True, True, 0.9),
    ("BILLBOARD_JAPAN", "CONFIRMATION", "MUSIC_CHART", "SEARCH", "CORE", "HTML", False, False, True, 1.05),
    ("APPLE_MUSIC_JP", "CONFIRMATION", "MUSIC_CHART", "SEARCH", "CORE", "API", False, False, True, 1.0),
    ("APPLE_MUSIC_KR", "CONFIRMATION", "MUSIC_CHART", "SEARCH", "CORE", "API", False, False, True, 0.9),
    ("APPLE_MUSIC_GLOBAL", "CONFIRMATION", "MUSIC_CHART", "SEARCH", "DISABLED", "API", False, False, True, 0.15),
    ("SPOTIFY_EMBED", "CONFIRMATION", "MUSIC_CHART", "SEARCH", "DISABLED", "HTML", False, False, True, 0.0),
    ("SPOTIFY_CHARTS_JP", "CONFIRMATION", "MUSIC_CHART", "SEARCH", "EXPERIMENTAL", "HTML", False, False, True, 0.8),
    ("NETFLIX_TV_JP", "CONFIRMATION", "SHOW_CHART", "EDITORIAL", "CORE", "HTML", False, False, True, 1.0),
    ("NETFLIX_FILMS_JP", "CONFIRMATION", "SHOW_CHART", "EDITORIAL", "CORE", "HTML", False, False, True, 0.95),
    ("TVER_RANKING_JP", "CONFIRMATION", "SHOW_CHART", "SOCIAL_DISCOVERY", "CORE", "HTML", False, False, True, 0.95),
    ("TIKTOK_CREATIVE_CENTER", "DISCOVERY", "SOCIAL_DISCOVERY", "SEARCH", "DISABLED", "HTML", False, True, True, 0.0),
    ("TIKTOK_CREATIVE_CENTER_HASHTAGS", "DISCOVERY", "SOCIAL_DISCOVERY", "SEARCH", "CORE", "HTML", False, True, False, 1.15),
    ("TIKTOK_CREATIVE_CENTER_SONGS", "DISCOVERY", "SOCIAL_DISCOVERY", "MUSIC_CHART", "CORE", "HTML", False, False, True, 1.0),
    ("TIKTOK_CREATIVE_CENTER_CREATORS", "DISCOVERY", "SOCIAL_DISCOVERY", "EDITORIAL", "EXPERIMENTAL", "HTML", False, False, True, 0.95),
    ("TIKTOK_CREATIVE_CENTER_VIDEOS", "DISCOVERY", "SOCIAL_DISCOVERY", "SEARCH", "EXPERIMENTAL", "HTML", False, True, False, 1.0),
    ("EDITORIAL_MODELPRESS", "EDITORIAL", "EDITORIAL", "SOCIAL_DISCOVERY", "CORE", "HTML", False, True, True, 0.95),
    ("EDITORIAL_FASHIONSNAP", "EDITORIAL", "EDITORIAL", "FASHION_STYLE", "CORE", "HTML", False, True, True, 0.95),
    ("EDITORIAL_MAGAZINE", "EDITORIAL", "EDITORIAL", "REFERENCE", "EXPERIMENTAL", "HTML", False, True, True, 0.8),
    ("YOUTUBE_TREND_JP", "CONFIRMATION", "VIDEO_CONFIRM", "SOCIAL_DISCOVERY", "EXPERIMENTAL", "API", True, False, True, 0.7),
    ("RAKUTEN_MAG", "EDITORIAL", "EDITORIAL", "REFERENCE", "DISABLED", "API", False, True, True, 0.4),
    ("X_SEARCH", "EVIDENCE_ONLY", "SOCIAL_DISCOVERY", "REFERENCE", "EXPERIMENTAL", "LLM_SEARCH", True, True, True, 0.0),
    ("WIKI_PAGEVIEWS", "REFERENCE", "REFERENCE", "EDITORIAL", "CORE", "API", False, False, True, 0.0),
)
CATALOG_SCHEMA = (
    "source_id string, role string, family_primary string, "
    "family_secondary string, status string, access_mode string, requires_credentials boolean, "
    "supports_phrase boolean, supports_entity boolean, max_weight_cap double, "
    "availability_tier string"
)


def catalog_rows() -> list[tuple]:
    """Catalog rows; the availability tier follows from the status."""
    return [(*row, "core" if row[4] == "CORE" else "experimental") for row in CATALOG]


# Sources the batch can fetch; the drift check compares against it.
FETCHABLE_SOURCES = tuple(
    r[0] for r in catalog_rows()
    if r[0] not in ("RAKUTEN_MAG", "X_SEARCH", "WIKI_PAGEVIEWS")
)


def catalog_df(spark: SparkSession) -> DataFrame:
    """29-row source dimension (safe to broadcast: its size is fixed here)."""
    return spark.createDataFrame(catalog_rows(), CATALOG_SCHEMA)


def domain_fit_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        domain_fit_rows(), "candidate_type string, family_primary string, fit double"
    )


# --- Fixed values: keyword lists ---------------------------------------------------------

KEYWORDS = {
    "business_keywords": "四季報 会社 投資 資格 受験 法律 税務 会計 決算 株 ir b2b professional".split(),
    "fashion_keywords": "コーデ メイク ネイル バッグ アクセ サングラス ファッション wear zozo look".split(),
    "consumer_keywords": "チャレンジ 界隈 活 交換 お守り デザイン ガジェット グッズ アイテム".split(),
    "entertainment_keywords": "ドラマ 映画 番組 恋リア アーティスト 曲 ライブ album track show".split(),
    "business_publishers": "東洋経済新報社 ダイヤモンド社 日経bp 中央経済社".split(),
    "sports_live_keywords": "先発 スタメン ゴール 打席 失点 勝ち越し pk 延長".split(),
    "play_by_play_keywords": "速報 試合中 途中経過 同点 逆転 得点 退場".split(),
    "generic_event_keywords": "結果 日程 出演 発表 公開 発売 放送 配信".split(),
    "politics_keywords": "選挙 首相 大統領 議会 国会 知事 政党".split(),
    "weather_disaster_keywords": "地震 津波 台風 雷 警報 大雨 積雪".split(),
    "finance_print_keywords": "決算 株価 相場 為替 配当 優待 買収".split(),
    "generic_phrase_blacklist": "現在 最新情報 話題になってる 今話題 おすすめ曲 注目作品".split(),
    "behavior_object_blacklist": "これ それ ここ みんな 今日 明日".split(),
    "behavior_object_whitelist": "メイク ネイル コーデ リップ バッグ シール トレカ お守り 香水 スニーカー".split(),
}
LIVE_WORDS = (
    KEYWORDS["sports_live_keywords"]
    + KEYWORDS["play_by_play_keywords"]
    + KEYWORDS["weather_disaster_keywords"]
)
FINANCE_WORDS = KEYWORDS["finance_print_keywords"] + KEYWORDS["politics_keywords"]
STOP_PHRASES = (
    "おすすめ", "まとめ", "ランキング", "人気", "話題", "トレンド", "バズ", "新作", "公式",
    "rank", "hashtags", "posts", "trend", "creators", "actions", "songs", "videos", "industry",
    "view more", "see analytics", "no related creator",
)
PROPER_NOUN_BLACKLIST = (
    "公式 新作 予告 人気 発表 最新 速報 話題 注目 おすすめ まとめ ランキング 特集 独占 配信 放送 "
    "開始 決定 情報 解禁 初公開 無料 限定 特別 完全 最強 衝撃 感動 ニュース エンタメ 芸能 音楽 "
    "映画 ドラマ official new latest best top breaking news update live full video music trailer "
    "teaser preview review reaction"
).split()
PROPER_NOUN_WHITELIST = ("IU", "AI", "UA", "YUI")
STYLE_TOKENS = "コーデ メイク ネイル ヘア レイヤード 着回し 春服 秋服 冬服 夏服".split()
PRODUCT_TOKENS = (
    "バッグ スニーカー サングラス スカート ジャケット デニム キャップ リップ ネックレス ブーツ"
).split()
BRAND_TOKENS = "コラボ 別注 限定".split()
BEHAVIOR_TOKENS = "界隈 活 チャレンジ する つける 付ける 交換 現象".split()
FALLBACK_BEHAVIOR_TOKENS = "界隈 活 チャレンジ する つける 付ける 交換 コーデ メイク".split()
OBJECT_SUFFIXES = ("活", "界隈", "チャレンジ", "メイク", "コーデ")
# Ordered (suffix, replacement); the first match wins.
LEMMA_RULES = (
    ("している", "する"), ("してる", "する"), ("した", "する"), ("して", "する"),
    ("つけてる", "つける"), ("つけた", "つける"), ("付けてる", "付ける"), ("付けた", "付ける"),
    ("持ってる", "持つ"), ("持った", "持つ"),
)
BEHAVIOR_TAILS = (
    "する", "した", "してる", "を(?:付ける|つける)", "を持つ", "交換", "コーデ", "メイク", "界隈",
    "活", "チャレンジ", "現象",
)
ALLOWLIST = {
    "publishers": "宝島社 集英社 講談社 扶桑社 主婦の友社 小学館".split(),
    "titles": "ViVi CanCam non-no anan SPUR Seventeen".split(),
    "deny_terms": "四季報 投資 資格 受験 法律 税務 会社".split(),
}
