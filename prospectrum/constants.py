"""Fixed values that results depend on, stated plainly."""

# Enumerations, in their order.
JOB_STATUS = ["PENDING", "DISCOVERING", "CRAWLING", "EXTRACTING", "ENRICHING", "PAUSED", "COMPLETED", "FAILED", "CANCELLED"]
STAGES = ["DISCOVERED", "CRAWLING", "CRAWL_FAILED", "CRAWLED", "EXTRACTING", "EXTRACT_FAILED", "EXTRACTED", "ENRICHING", "ENRICH_FAILED", "ENRICHED"]
SIGNAL_TYPES = ["HIRING", "FUNDING", "EXPANSION", "PRODUCT_LAUNCH", "OTHER"]
CHANNELS = ["EMAIL", "WHATSAPP", "LINKEDIN"]
CAMPAIGN_STATUS = ["DRAFT", "SCHEDULED", "RUNNING", "PAUSED", "COMPLETED", "FAILED"]
RECIPIENT_STATUS = ["PENDING", "SENT", "DELIVERED", "OPENED", "CLICKED", "REPLIED", "BOUNCED", "FAILED", "UNSUBSCRIBED"]

# Ranks of recipient states, weights and labels.
STATUS_RANK = {"PENDING": 0, "FAILED": 1, "SENT": 2, "BOUNCED": 2, "UNSUBSCRIBED": 2, "DELIVERED": 3, "OPENED": 4, "CLICKED": 5, "REPLIED": 6}
SIGNAL_WEIGHT = {"HIRING": 0.25, "FUNDING": 0.35, "EXPANSION": 0.3, "PRODUCT_LAUNCH": 0.2, "OTHER": 0.1}
HALF_LIFE_DAYS = 30
CHANNEL_LABEL = {"EMAIL": "Email", "WHATSAPP": "WhatsApp", "LINKEDIN": "LinkedIn"}
TERMINAL_STATUS = ["SENT", "DELIVERED", "OPENED", "CLICKED", "REPLIED", "BOUNCED"]
ACTIVE_CAMPAIGN = ["DRAFT", "SCHEDULED", "RUNNING", "PAUSED"]
FAILED_STAGES = ["CRAWL_FAILED", "EXTRACT_FAILED", "ENRICH_FAILED"]
CRAWLED_STAGES = ["CRAWLED", "EXTRACTING", "EXTRACT_FAILED", "EXTRACTED", "ENRICHING", "ENRICH_FAILED", "ENRICHED"]
EXTRACTED_STAGES = ["EXTRACTED", "ENRICHING", "ENRICH_FAILED", "ENRICHED"]
ACTIVE_JOBS = ["DISCOVERING", "CRAWLING", "EXTRACTING", "ENRICHING"]
SEND_RATE_PER_MINUTE = {"EMAIL": 50, "WHATSAPP": 20, "LINKEDIN": 10}
EMPTY_LABEL = "—"

# Event types of the three providers, their state and time field.
PROVIDER_EVENTS = [
    ("email", "email.sent", "SENT", None),
    ("email", "email.delivered", "DELIVERED", "deliveredAt"),
    ("email", "email.opened", "OPENED", "openedAt"),
    ("email", "email.clicked", "CLICKED", "clickedAt"),
    ("email", "email.bounced", "BOUNCED", "bouncedAt"),
    ("email", "email.complained", "UNSUBSCRIBED", None),
    ("whatsapp", "sent", "SENT", None),
    ("whatsapp", "delivered", "DELIVERED", "deliveredAt"),
    ("whatsapp", "read", "OPENED", "readAt"),
    ("whatsapp", "failed", "FAILED", None),
    ("linkedin", "message.sent", "SENT", None),
    ("linkedin", "message.delivered", "DELIVERED", "deliveredAt"),
    ("linkedin", "message.read", "OPENED", "openedAt"),
    ("linkedin", "message.received", "REPLIED", "repliedAt"),
    ("linkedin", "message.replied", "REPLIED", "repliedAt"),
]

# Domains that are no company's own.
BLOCKED_DOMAINS = [
    "linkedin.com", "facebook.com", "twitter.com", "x.com", "wikipedia.org", "youtube.com", "instagram.com", "yelp.com", "crunchbase.com",
    "bloomberg.com", "dnb.com", "glassdoor.com", "indeed.com", "monster.com", "google.com", "bing.com", "duckduckgo.com", "reddit.com",
    "tiktok.com", "amazon.com", "ebay.com", "apple.com", "microsoft.com", "zoominfo.com", "pitchbook.com", "mapquest.com",
    "yellowpages.com", "bbb.org", "trustpilot.com",
]
BLOCKED_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "::1", "metadata.google.internal"]

# E-mail and phone lists. Dial codes are tried in this order.
PLACEHOLDER_EMAIL_DOMAINS = [
    "example.com", "example.org", "example.net", "test.com", "domain.com", "email.com", "sample.com", "localhost", "invalid.com",
    "test.test",
]
GENERIC_LOCAL_PARTS = [
    "info", "sales", "contact", "hello", "support", "admin", "office", "team", "marketing", "hr", "careers", "press", "media", "billing",
    "service", "customerservice", "enquiries", "inquiries", "noreply", "no-reply", "donotreply", "postmaster", "webmaster",
]
PLACEHOLDER_PHONES = ["1234567", "12345678", "123456789", "1234567890", "0123456789", "9876543210", "1111111", "2222222", "9999999", "0000000"]
DIAL_CODES = [
    "358", "351", "352", "353", "354", "355", "356", "357", "359", "370", "371", "372", "373", "374", "375", "376", "377", "378", "380",
    "381", "382", "383", "385", "386", "387", "389", "420", "421", "423", "44", "45", "46", "47", "48", "49", "33", "34", "36", "39", "40",
    "41", "43", "30", "31", "32", "20", "27", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66",
    "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "1", "7",
]

# Industry synonyms by group.
INDUSTRY_GROUPS = {
    "logistics": ["logistics", "freight", "supply chain", "transportation", "shipping", "warehousing", "courier", "delivery"],
    "saas": ["saas", "software", "cloud", "b2b software", "enterprise software"],
    "fintech": ["fintech", "financial", "finance", "financial technology", "financial services", "payments", "payment", "banking", "insurtech"],
    "manufacturing": ["manufacturing", "industrial", "production", "factory", "automation", "robotics"],
    "healthcare": ["healthcare", "health", "medical", "pharma", "biotech"],
    "retail": ["retail", "ecommerce", "e-commerce", "consumer goods"],
    "consulting": ["consulting", "professional services", "advisory"],
    "technology": ["technology", "tech", "it", "information technology"],
}

# Completeness weights of a profile, in the order they are added.
COMPLETENESS = {
    "companyName": 0.09, "description": 0.09, "industry": 0.09, "products": 0.07, "services": 0.07, "targetCustomers": 0.07,
    "estimatedCompanySize": 0.08, "city": 0.06, "country": 0.06, "decisionMaker": 0.08, "decisionMakerEmail": 0.03,
    "decisionMakerPhone": 0.03, "decisionMakerLinkedInUrl": 0.03, "linkedInUrl": 0.05, "xUrl": 0.03, "email": 0.05, "phone": 0.03,
    "revenue": 0.08,
}

# Prompt injection patterns; the first match of each is replaced.
INJECTION_PATTERNS = [
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"disregard\s+(all\s+)?(prior|previous|above)\s+(instructions|rules)",
    r"you\s+are\s+now\s+",
    r"\bsystem\s*:\s*",
    r"\bassistant\s*:\s*",
    r"</?(?:system|assistant|user|instruction|prompt)>",
    r"```(?:system|assistant)",
]

# Crawl paths and page order.
CRAWL_PATHS = ["/", "/about", "/company", "/contact", "/careers"]

# Rules of page cleaning.
REMOVABLE_TAGS = ["script", "style", "noscript", "iframe", "svg", "canvas", "video", "audio"]
BOILERPLATE_TAGS = ["nav", "header", "footer", "aside"]
BOILERPLATE_ROLES = ["navigation", "banner", "contentinfo", "complementary"]
BOILERPLATE_TOKENS = ["nav", "navbar", "menu", "breadcrumb", "cookie", "consent", "gdpr", "sidebar", "social", "share", "advert", "pagination", "footer", "header"]
LOW_SCORE_TOKENS = [
    "nav", "navbar", "menu", "breadcrumb", "cookie", "consent", "gdpr", "onetrust", "sidebar", "social", "share", "advert", "ad-slot",
    "pagination", "pager", "site-footer", "site-header",
]
BLOCK_TAGS = ["p", "div", "section", "article", "main", "li", "td", "th", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "tr"]
JSON_LD_TYPES = ["Organization", "LocalBusiness", "Corporation", "WebSite", "ProfessionalService"]
BUSINESS_PATTERN = (
    r"\b(\d{2,5}\+?\s*(employees|staff|people|team members)|contact|email|phone|address|headquarters|hq|founded|established"
    r"|since\s+\d{4}|services|products|solutions|logistics|warehousing|freight)\b"
)
EMAIL_PATTERN = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
PHONE_PATTERN = r"\+?\d[\d\s().-]{7,}\d"

# What each role may do.
ALL_ROLES = ["ADMIN", "MANAGER", "SALES_REP"]
PERMISSIONS = {
    "search:create": ALL_ROLES,
    "search:read": ALL_ROLES,
    "campaign:create": ALL_ROLES,
    "campaign:read": ALL_ROLES,
    "campaign:send": ALL_ROLES,
    "campaign:delete": ALL_ROLES,
    "outreach:generate": ALL_ROLES,
    "analytics:read": ["ADMIN", "MANAGER"],
    "user:manage": ["ADMIN"],
    "org:services:edit": ["ADMIN"],
    "refresh:manage": ALL_ROLES,
    "saved-search:read": ALL_ROLES,
    "saved-search:write": ALL_ROLES,
}
