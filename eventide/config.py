"""Constants and word lists of the operators, as parameters. Pass another value to change one."""

from __future__ import annotations

from dataclasses import dataclass, field

# Word lists that decide results.
GENERIC_KEYWORDS = ("最新", "突发", "热搜", "官方", "网友", "视频", "现场", "如何看待", "怎么回事", "一男子", "一女子", "多人", "多地", "回应", "通报")
ACTIONS = ("回应", "通报", "发布", "曝光", "举报", "调查", "处罚", "起诉", "判决", "道歉", "辟谣", "下架", "召回", "暂停", "恢复", "涉嫌", "发生", "引发", "确认", "否认", "约谈", "立案", "抓获", "救援")
ENTITY_MARKERS = ("公司", "大学", "学院", "医院", "学校", "平台", "集团", "警方", "法院", "市", "省")
EVENT_TYPES = (
    ("public_safety", ("事故", "火灾", "地震", "救援", "伤亡", "警方")),
    ("legal_case", ("起诉", "判决", "立案", "抓获", "涉嫌", "法院")),
    ("consumer_rights", ("投诉", "召回", "下架", "维权", "消费者", "质量")),
    ("policy_notice", ("政策", "通知", "规定", "办法", "发布", "调整")),
    ("education", ("学校", "高考", "中考", "学生", "教师", "教育")),
    ("health", ("医院", "医生", "疾病", "感染", "疫苗", "药品")),
    ("public_issue", ("回应", "通报", "网友", "引发", "关注", "争议")),
)
NOISE_FLAGS = ("historical_content_pollution", "time_window_conflict", "marketing_spam", "unrelated_result", "entity_conflict")
TEMPLATE_PHRASES = ("展开全文", "责任编辑", "免责声明", "来源：", "原文链接")
QUESTION_SHELLS = ("如何看待", "怎么看待", "怎样看待", "如何评价", "怎么评价", "为什么")
PUBLIC_HEAT_TERMS = ("全网热议", "公众热议", "广泛关注", "全民关注")
FACT_TERMS = ("证实", "确认", "事实证明", "已坐实")
GENERIC_TOPICS = ("热议", "热搜", "热点")
HARMLESS_FLAGS = ("missing_summary", "missing_author", "html_summary", "no_raw_metrics", "rss_order_not_official_rank", "missing_hot_value")
PLATFORM_LABELS = {"zhihu": "知乎", "weibo": "微博", "official": "官媒"}
RELATIVE_TIMES = ("今天", "昨天", "昨日", "今日", "明天", "前天", "本周", "上周", "这周", "今年", "去年", "本月", "上月", "刚刚", "小时前", "分钟前")
TECHNICAL_REVIEWS = ("technical_error",)
TECHNICAL_ERRORS = ("llm_unverifiable_evidence", "llm_invalid_response", "llm_timeout", "llm_network_error", "llm_candidate_retrieval_unavailable", "llm_input_budget_exceeded", "llm_cache_miss")
COMPARABLE_ENTITY_SUFFIXES = ("公司", "大学", "医院", "法院")

# What a title states that two titles can disagree on.
DATE_PATTERN = r"(20\d{2})[-年/](\d{1,2})[-月/](\d{1,2})"
MODEL_PATTERN = r"(?<![A-Za-z0-9])([A-Za-z]+-?\d+[A-Za-z]*)(?![A-Za-z0-9])"
MODEL_YEAR_PATTERN = r"(20\d{2})款"
EPISODE_PATTERN = r"第\s*(\d+)\s*[话期集章]"
PLACE_PATTERN = r"(?:^|[，,：:。；;]|位于|来自)([\x{4e00}-\x{9fff}]{2,5}?)(?:全市|市|省)"
NOT_PLACES = ("上市", "进入", "提醒", "宣布", "发布", "获批", "全国")
BRIDGE_PATTERN = r"(?:^|市)([\x{4e00}-\x{9fff}]{2,8}?大桥)"
TITLE_ACTIONS = {"recall": ("召回",), "release": ("发布", "亮相"), "cancel": ("取消", "不再安排"), "add": ("新开设", "新增", "增设")}
TITLE_HAZARDS = {"rain": ("暴雨", "强降雨"), "heat": ("高温", "酷暑"), "earthquake": ("地震",), "typhoon": ("台风",), "snow": ("暴雪",)}

# Flags under which two scores don't compare.
SCORE_INVALID_FLAGS = ("incomparable_scores", "freshness_only_change", "sampling_changed", "score_config_changed")

# Where a news page's text stands, and how lines begin that aren't part of it.
ARTICLE_CONTAINERS = ("left_zw", "leftzw", "rm_txt_con", "article-content", "article_content", "articlecontent", "content_area", "main-aticle", "xlcontent", "main-content", "rich_media_content", "article-body", "articlebody", "detail")
ARTICLE_NOISE = r"^(?:责任编辑|相关阅读|推荐阅读|版权声明|扫码|分享到|广告|返回顶部|总监制|监制[丨：:]|主编[丨：:]|编辑[丨：:&]|制图[丨：:]|策划[丨：:])"
#: Elements whose text isn't shown, and elements that have no end tag.
SILENT_ELEMENTS = ("script", "style", "nav", "footer", "aside", "noscript")
VOID_ELEMENTS = ("meta", "link", "img", "br", "hr", "input", "source", "wbr", "area")
SENTENCE_FACTS = r"\d|发生|发布|通报|宣布|救援|调查|发运|获悉|启动"

# Orders of the sort key, lower first.
SUPPORT_RANK = {"supported": 0, "weak_supported": 1, "not_found": 2, "not_checked": 3}
MATCH_RANK = {"natural_topn_overlap": 0, "search_supported": 1, "weak_search_supported": 2, "single_platform_only": 3, "official_only": 4, "none": 5, "unknown": 6}
BUCKET_RANK = {"top3": 0, "top10": 1, "top20": 2, "tail": 3, "unknown": 4}
DELTA_RANK = {"rising": 0, "stable": 1, "falling": 2, "unknown": 3}
HIT_RANK = {"same_id_or_title": 0, "entity_action_match": 1, "keyword_overlap": 2, "none": 3, "unknown": 4}
FRESHNESS_RANK = {"24h": 0, "72h": 1, "7d": 2, "stale": 3, "unknown": 4}
HEALTH_RANK = {"use": 0, "fallback": 1, "unavailable": 2, "unknown": 3}
CATEGORIES = ("A_cross_platform_with_official", "B_single_platform_with_search_and_official", "C_cross_platform_without_official", "D_single_platform_with_official", "E_single_platform_only", "F_official_only", "unknown")
CATEGORY_RANK = {name: k for k, name in enumerate(CATEGORIES)}


@dataclass(frozen=True)
class Bm25Config:
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class MatchConfig:
    retrieval_limit: int = 20
    rerank_auto: float = 0.85
    rerank_reject: float = 0.10
    keyword_high: float = 0.55
    ngram_high: float = 0.50
    bm25_min: float = 0.45
    embedding_candidate: float = 0.78
    embedding_auto: float = 0.86
    window_hours: float = 72.0
    auto_merge: float = 0.85
    review: float = 0.60
    margin: float = 0.03
    rrf_k: int = 60
    use_embedding: bool = False
    use_reranker: bool = False


@dataclass(frozen=True)
class HeatConfig:
    native_half: float = 1e7
    engagement_cap: float = 1e4
    total_cap: float = 1e5
    matched_cap: float = 50.0
    bonus: float = 0.05
    bonus_members: int = 3
    seed_floor: float = 0.30
    rss_scale: float = 0.20
    rss_half_life_hours: float = 2.0


@dataclass(frozen=True)
class TrendConfig:
    expected_interval_minutes: float = 60.0
    cap_minutes: float = 1440.0
    rank_threshold: float = 1.0
    score_threshold: float = 0.05
    native_ratio_threshold: float = 0.05

    @property
    def max_gap_minutes(self) -> float:
        return 2 * self.expected_interval_minutes


@dataclass(frozen=True)
class SupportConfig:
    keyword_min: float = 0.5
    keyword_count: int = 2
    ngram_min: float = 0.45
    rerank_min: float = 0.85
    rerank_reject: float = 0.20
    fresh_days: float = 7.0


@dataclass(frozen=True)
class Dictionaries:
    generic: tuple[str, ...] = GENERIC_KEYWORDS
    actions: tuple[str, ...] = ACTIONS
    markers: tuple[str, ...] = ENTITY_MARKERS
    event_types: tuple = field(default=EVENT_TYPES)


def profile(name: str) -> MatchConfig:
    """The matching profile ``rules``, ``hybrid`` or ``hybrid_rerank``; the last two use scores of
    an embedding, the last also a reranker's, where the caller supplies them."""
    if name not in ("rules", "hybrid", "hybrid_rerank"):
        raise ValueError(f"unknown matching profile: {name}")
    return MatchConfig(use_embedding=name != "rules", use_reranker=name == "hybrid_rerank")

# Where a search response keeps its list and its number of hits, and what a status has.
ENVELOPE_LISTS = ("statuses", "items", "Items", "list", "List", "results", "Results")
ENVELOPE_TOTALS = ("total_number", "total", "Total", "count", "Count")
STATUS_KEYS = ("text", "text_raw", "id", "idstr", "mid")

# Characters that part a title's tokens, and that terms lose at both ends.
TOKEN_BREAKS = r"[\s,，。.!！？?;；:：、/\\|()\[\]{}<>《》「」『』“”\"'`~]+"
TERM_EDGES = " #，。！？!?;；:：、/\\|()[]{}<>《》「」『』“”\"'`~"
