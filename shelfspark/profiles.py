"""Site- and job-specific values, kept as data so that the operators stay general.

Everything under a "fixed values" comment must equal the published rules for the
results to agree; the rest are parameters with neutral defaults.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: item identifiers --------------------------------------
ITEM_ID = "[A-Za-z0-9]{10}"


@dataclass(frozen=True)
class UrlProfile:
    """How one catalog site lays out its URLs; the defaults are fixed values."""

    domain: str = "shop.example"
    item_prefix: str = "https://shop.example/dp/"
    item_id: str = ITEM_ID
    item_patterns: tuple[str, ...] = (
        "/dp/([A-Za-z0-9]{10})",
        "/gp/product/([A-Za-z0-9]{10})",
    )
    key_pattern: str = "(?i)/(?:dp|gp/product)/([A-Z0-9]{10})"
    listing_prefix: str = "/gp/bestsellers"
    default_section: str = "kitchen"
    page_param: str = "pg"
    page_path_pattern: str = "zg_bs_pg_([0-9]+)_"
    page_ref: str = "/ref=zg_bs_pg_{page}_{section}"
    page_query: str = "?ie=UTF8&pg={page}"
    start_ref: str = "/ref=zg_bs_nav_{section}_0"

    @property
    def prefix_parts(self) -> tuple[str, ...]:
        return tuple(p for p in self.listing_prefix.split("/") if p)


# ---- fixed values: section names and their slugs -------------------------
SECTION_SLUGS = {
    "amazon launchpad": "boost",
    "amazon renewed": "amazon-renewed",
    "apps & games": "mobile-apps",
    "apps and games": "mobile-apps",
    "baby products": "baby",
    "bags, wallets and luggage": "luggage",
    "beauty": "beauty",
    "books": "books",
    "car & motorbike": "automotive",
    "car and motorbike": "automotive",
    "clothing & accessories": "apparel",
    "clothing and accessories": "apparel",
    "computers & accessories": "computers",
    "computers and accessories": "computers",
    "electronics": "electronics",
    "garden & outdoors": "garden",
    "garden and outdoors": "garden",
    "gift cards": "gift-cards",
    "grocery & gourmet foods": "grocery",
    "grocery and gourmet foods": "grocery",
    "health & personal care": "hpc",
    "health and personal care": "hpc",
    "home & kitchen": "kitchen",
    "home and kitchen": "kitchen",
    "home improvement": "home-improvement",
    "industrial & scientific": "industrial",
    "industrial and scientific": "industrial",
    "jewellery": "jewelry",
    "jewelry": "jewelry",
    "kindle store": "digital-text",
    "movies & tv shows": "dvd",
    "movies and tv shows": "dvd",
    "music": "music",
    "musical instruments": "musical-instruments",
    "office products": "office",
    "pet supplies": "pet-supplies",
    "shoes & handbags": "shoes",
    "shoes and handbags": "shoes",
    "software": "software",
    "sports, fitness & outdoors": "sports",
    "sports, fitness and outdoors": "sports",
    "toys & games": "toys",
    "toys and games": "toys",
    "video games": "videogames",
    "watches": "watches",
}


@dataclass(frozen=True)
class PageProfile:
    """Which markup of a stored page carries which field.

    The defaults are fixed values: markers, patterns and phrases.
    Patterns use syntax that Java and RE2 read alike.
    """

    title_patterns: tuple[str, ...] = (
        r"""(?is)<span[^>]*id=["']productTitle["'][^>]*>(.*?)</span>""",
        r"(?is)<title>(.*?)</title>",
    )
    title_suffix: str = r"(?i)\s*:\s*Amazon\.in.*$"
    points_markers: tuple[str, ...] = ('id="feature-bullets"', "id='feature-bullets'")
    points_block: int = 0  # characters from the marker on; 0: to the end of the page
    point_pattern: str = r"(?is)<li[^>]*>(.*?)</li>"
    point_skip_prefix: str = "make sure this fits"
    meta_pattern: str = (
        r"""(?is)<meta[^>]*name=["']description["'][^>]*content=["'](.*?)["']"""
    )
    media_json_pattern: str = r'(?i)"videoURL"\s*:\s*"([^"]+)"'
    media_url_pattern: str = (
        r"""(?i)https?:[\\/]+[^"'\s<>]+?\.(?:m3u8|mp4)(?:[^"'\s<>]*)"""
    )
    media_suffixes: tuple[str, ...] = (".m3u8", ".mp4")
    presence_marker: str = 'id="altImages"'
    presence_block: int = 0
    thumb_pattern: str = r"(?i)\bvideoThumbnail\b"
    action_pattern: str = r"(?i)openVideoImmersiveView|chromeful-video"
    count_pattern: str = r"""(?i)id=["']videoCount["'][^>]*>\s*([0-9]+)\s+VIDEOS?"""
    signals: tuple[str, str, str, str] = (
        "videoThumbnail-class",
        "openVideoImmersiveView/chromeful-video",
        "videoCount-label",
        "media-url-in-page",
    )
    blocked_phrases: tuple[str, ...] = (
        "captcha",
        "enter the characters you see below",
        "type the characters you see in this image",
        "api-services-support@amazon.com",
    )
    blocked_error: str = "Bot challenge / captcha page returned"
    item_attr_pattern: str = r"""(?is)\bdata-asin=["']([^"']*)["']"""
    item_json_pattern: str = r"""(?is)\bdata-client-recs-list=(?:"([^"]*)"|'([^']*)')"""
    item_json_id: str = r'(?i)"id"\s*:\s*"([A-Z0-9]{10})"'
    # The links a listing page offers; each is a whole opening tag.
    card_link_pattern: str = r"(?is)<a\b[^>]*>"
    card_link_class: str = "a-link-normal"
    next_link_patterns: tuple[str, ...] = (
        r"""(?is)<li[^>]*\ba-last\b[^>]*>\s*<a[^>]*\bhref=["']([^"']*)["']""",
        r"""(?is)<a(?=[^>]*aria-label=["']Go to next page["'])[^>]*\bhref=["']([^"']*)["']""",
        r"""(?is)<a(?=[^>]*class=["'][^"']*\bs-pagination-next\b)[^>]*\bhref=["']([^"']*)["']""",
    )
    pagination_pattern: str = r"""(?is)<ul[^>]*class=["'][^"']*\ba-pagination\b[^>]*>(.*?)</ul>"""
    page_link_pattern: str = r"""(?is)<li[^>]*>\s*<a[^>]*\bhref=["']([^"']*)["']"""


@dataclass(frozen=True)
class LinkProfile:
    """Where the link tree of a listing page lives."""

    nav_pattern: str = ""  # captures the nav root; empty = whole page
    href_contains: str = "/gp/bestsellers"
    list_tag: str = "ul"
    list_class: str = "zg-browse"
    up_tag: str = "li"
    up_class: str = "zg-browse-up"


# ---- fixed values: scraped-noise tokens, tested in this order -------------
NOISE_TOKENS = (
    "window.$Nav",
    "Sponsored window.$Nav",
    "aax-eu-zaz.amazon.in",
    "amazonmobile://intent?",
    '"renderingContext"',
    "window.P &&",
    "$Nav.when(",
    "Sign in New customer?",
    "Your Lists Create a Wish List",
    "accountListContent",
    "data-csa-c-",
)
NOISE_MAX = 2200

# ---- fixed values: link-line labels, title suffix, texts ------------------
LABEL_LINES = r"(?im)^\s*(product\s*url|affiliate\s*tag)\s*:.*$"
TITLE_SUFFIX = "(MALAYALAM)"
TITLE_SUFFIX_VARIANT = r"(?i)\(\s*malayalam\s*\)\s*$"
TITLE_DEFAULT = "Product Review"
DESCRIPTION_INTRO = (
    " explained in this short video with practical highlights and real-use context."
)
DESCRIPTION_FEATURES = "Key features: "
DESCRIPTION_REASONS = "Why it matters: "
DESCRIPTION_OUTRO = "Watch till the end for a quick buying perspective in Malayalam."
FALLBACK_LINE = "ഈ ഉൽപ്പന്നം ഇപ്പോൾ തന്നെ പരീക്ഷിക്കൂ."
FALLBACK_CLOSE = "ഇത് ഇന്ന് തന്നെ ഓർഡർ ചെയ്യൂ."

# ---- fixed values: English stopwords of the keyword rule ------------------
STOPWORDS = (
    "a", "an", "the", "and", "or", "for", "to", "of", "in", "on", "at", "by", "with", "from",
    "into", "your", "you", "this", "that", "these", "those", "is", "are", "was", "were", "be",
    "been", "being", "it", "its", "as", "about", "how", "what", "why", "when", "where", "who",
    "which", "will", "can", "could", "should", "would", "may", "might", "than", "then", "also",
    "very", "more", "most", "best", "new", "now", "today", "video", "short", "reel", "review",
    "product", "amazon", "india", "buy",
)

# ---- fixed values: phrase lists -------------------------------------------
OPENING_PHRASES = (
    "stop scrolling",
    "nobody talks",
    "nobody tells",
    "i wish i knew",
    "changed everything",
    "mistake",
    "before",
    "after",
    "truth",
)
CLOSING_BANNED_PHRASES = (
    "link in bio",
    "check the link in bio",
    "bio link",
    "ലിങ്ക് ഇൻ ബയോ",
    "ബയോയിലെ ലിങ്ക്",
    "ബയോ യിലെ ലിങ്ക്",
    "bioയിലെ ലിങ്ക്",
    "bio യിലെ ലിങ്ക്",
)

# ---- fixed values: error tokens (matched in upper case, anywhere) ---------
RATE_TOKENS = ("RESOURCE_EXHAUSTED", "RATE_LIMIT", "TOO MANY REQUESTS", "QUOTA", "429")
TRANSIENT_TOKENS = (
    "REMOTEPROTOCOLERROR",
    "SERVER DISCONNECTED",
    "READTIMEOUT",
    "CONNECTTIMEOUT",
    "TIMEOUT",
    "CONNECTIONRESETERROR",
    "CONNECTION ABORTED",
    "NETWORK",
    "UNAVAILABLE",
    "503",
    "500",
    "502",
    "504",
)
DAILY_TOKENS = ("GENERATEREQUESTSPERDAY", "PERDAY")
NO_AUDIO_TOKENS = ("TTS RETURNED NO AUDIO", "NO AUDIO BYTES RETURNED BY TTS MODEL")
DELAY_PATTERNS = (
    r"(?i)retry in ([0-9]+(?:\.[0-9]+)?)s",
    r"""(?i)retryDelay['"]?\s*:\s*'([0-9]+(?:\.[0-9]+)?)s'""",
    r"""(?i)retryDelay['"]?\s*:\s*"([0-9]+(?:\.[0-9]+)?)s\"""",
)

# ---- fixed values: daily publish slots ------------------------------------
DAILY_SLOTS = ("11:30", "17:30", "19:30")
