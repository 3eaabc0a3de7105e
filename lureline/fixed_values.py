"""Word lists, patterns, thresholds and texts that results depend on."""

# ---- fixed values: feature vector order -------------------------------------------------
FEATURE_NAMES = [
    "NumDots", "SubdomainLevel", "PathLevel", "UrlLength", "NumDash", "NumDashInHostname",
    "AtSymbol", "TildeSymbol", "NumUnderscore", "NumPercent", "NumQueryComponents",
    "NumAmpersand", "NumHash", "NumNumericChars", "NoHttps", "RandomString", "IpAddress",
    "DomainInSubdomains", "DomainInPaths", "HttpsInHostname", "HostnameLength", "PathLength",
    "QueryLength", "DoubleSlashInPath", "NumSensitiveWords", "EmbeddedBrandName",
    "PctExtHyperlinks", "PctExtResourceUrls", "ExtFavicon", "InsecureForms",
    "RelativeFormAction", "ExtFormAction", "AbnormalFormAction",
    "PctNullSelfRedirectHyperlinks", "FrequentDomainNameMismatch", "FakeLinkInStatusBar",
    "RightClickDisabled", "PopUpWindow", "SubmitInfoToEmail", "IframeOrFrame", "MissingTitle",
    "ImagesOnlyInForm", "SubdomainLevelRT", "UrlLengthRT", "PctExtResourceUrlsRT",
    "AbnormalExtFormActionR", "ExtMetaScriptLinkRT", "PctExtNullSelfRedirectHyperlinksRT",
]
URL_TABLE_FEATURES = FEATURE_NAMES[:24]

# ---- fixed values: URL vocabulary --------------------------------------------------------
SUSPICIOUS_HOST_WORDS = [
    "secure", "account", "update", "suspend", "verify", "confirm", "banking", "paypal",
    "amazon", "microsoft", "apple", "google", "facebook", "instagram", "twitter",
]
SENSITIVE_TERMS = [
    "verify", "update", "confirm", "suspend", "restrict", "urgent", "expire", "click here",
    "act now", "limited time",
]
BRANDS = [
    "paypal", "amazon", "google", "microsoft", "apple", "facebook", "netflix", "ebay",
    "instagram", "twitter", "linkedin", "yahoo",
]
BRAND_TYPOS = [
    "paypa1", "paypai", "paypall", "paypa|", "g00gle", "gooogle", "googel", "gogle",
    "amaz0n", "amazan", "arnazon", "amazom", "micros0ft", "micosoft", "microsaft", "rnicrosof",
]
SUSPICIOUS_TLDS = [
    ".tk", ".ml", ".ga", ".cf", ".info", ".biz", ".click", ".download", ".review", ".top",
    ".win", ".bid", ".loan",
]
URL_SHORTENERS = ["bit.ly", "tinyurl", "goo.gl", "ow.ly", "t.co"]

# ---- fixed values: mail keyword lists ------------------------------------------------------
URGENCY_KEYWORDS = [
    "urgent", "immediate", "act now", "expire", "suspend", "deadline", "limited time", "hurry",
    "quick", "fast", "asap", "important",
]
AUTHORITY_KEYWORDS = [
    "bank", "security", "official", "government", "irs", "tax", "police", "fbi", "legal",
    "court", "administrator", "support",
]
FINANCIAL_KEYWORDS = [
    "payment", "invoice", "refund", "credit", "debit", "account", "transaction", "money",
    "dollar", "bitcoin", "prize", "lottery",
]
ACTION_KEYWORDS = [
    "click", "verify", "confirm", "update", "validate", "check", "review", "download",
    "install", "open", "view", "see",
]
THREAT_KEYWORDS = [
    "suspend", "terminate", "close", "block", "lock", "disable", "deactivate", "expire",
    "cancel", "delete", "remove",
]
CONFIDENCE_WEIGHTS = {
    "urgency_score": 0.15, "authority_score": 0.10, "financial_score": 0.10,
    "action_score": 0.10, "threat_score": 0.15, "has_ip": 0.10, "suspicious_tld": 0.05,
    "sentiment_negative": 0.05, "misspelling_score": 0.05, "special_char_ratio": 0.05,
    "has_at_symbol": 0.05, "shortening_service": 0.05,
}

# ---- fixed values: page markers ------------------------------------------------------------
NULL_HREFS = ["#", "", "javascript:void(0)", "javascript:;"]
RIGHT_CLICK_MARKERS = [
    'oncontextmenu="return false"', "event.button==2", "preventdefault", "disableselect",
]
MAX_PAGE_BYTES = 5 * 1024 * 1024

# ---- fixed values: message routing ----------------------------------------------------------
GREETINGS = ["hello", "hi", "hey", "greetings", "good morning", "good afternoon", "good evening"]
HELP_WORDS = ["help", "how", "what", "explain", "guide", "assist"]
MAIL_INDICATORS = [
    "subject:", "dear", "hello", "hi there", "from:", "to:", "sent:", "date:", "thank you",
    "regards", "sincerely", "best regards", "order number", "receipt", "invoice",
    "confirmation", "verify your account", "click here", "urgent", "suspended",
    "confirm your", "update your", "unsubscribe", "manage preferences",
]
MAIL_OPENINGS = ["dear", "hello", "hi there", "greetings"]
MAIL_CLOSINGS = ["regards", "sincerely", "thank you", "thanks"]
ROUTE_TEXT = {
    "greeting": "Hello! I'm your AI-powered phishing detection assistant. I can help you identify suspicious URLs and emails. Just paste any link or email content you'd like me to check.",
    "help": "Here's how I can help you:\n\n1. **Check URLs**: Send me any suspicious link and I'll analyze it for phishing indicators\n2. **Analyze Emails**: Paste email content and I'll check for phishing attempts\n3. **Risk Assessment**: I'll provide a risk level (Low/Medium/High) with explanations\n4. **Recommendations**: I'll suggest what action you should take\n\nJust paste the URL or email you want me to check!",
    "mail_url": "I found a URL in your email. Let me analyze it for you...",
    "mail": "I'll analyze this email content for phishing indicators...",
    "url": "I found a URL in your message. Let me analyze it for you...",
    "unclear": "I can help you check if a URL or email is a phishing attempt. Please share the suspicious link or email content you'd like me to analyze.",
}
FEATURE_DISPLAY = {
    "NumDots": "Excessive dots in URL",
    "SubdomainLevel": "Suspicious subdomain depth",
    "UrlLength": "Unusually long URL",
    "NoHttps": "Missing secure connection (HTTPS)",
    "IpAddress": "Uses IP address instead of domain",
    "NumDash": "Multiple dashes in URL",
    "AtSymbol": "Contains @ symbol (possible redirect)",
    "RandomString": "Random characters in domain",
    "NumSensitiveWords": "Contains suspicious keywords",
    "EmbeddedBrandName": "Brand name used suspiciously",
}
REPLY_TIPS = {
    "high": "\n**Safety Tips:**\n• Do not click on any links\n• Do not provide personal information\n• Report this to your IT security team\n• Delete the message\n",
    "medium": "\n**Proceed with caution:**\n• Verify the sender independently\n• Check the actual URL by hovering (don't click)\n• Look for spelling and grammar errors\n",
    "low": "",
}

# ---- fixed values: risk tiers -----------------------------------------------------------------
TIERS = {
    "low": {
        "color": "#28a745", "icon": "✅", "urgency": "low",
        "recommendation": "This appears safe, but always be cautious with unexpected links.",
        "description": "The content shows minimal signs of being a phishing attempt.",
        "why_risky": "The content shows few characteristics typical of phishing attempts.",
        "action_items": [
            "Proceed with normal caution",
            "Verify sender if email is unexpected",
            "Check URL in address bar after clicking",
        ],
        "warning_signs": [
            "Unexpected emails from unknown senders",
            "Urgent language or time pressure",
            "Generic greetings like 'Dear Customer'",
        ],
        "tactics": [
            "Phishers often impersonate trusted organizations",
            "They create urgency to bypass critical thinking",
            "Legitimate companies rarely ask for passwords via email",
        ],
        "immediate": [
            "Proceed with normal caution",
            "Stay alert for suspicious behavior",
        ],
    },
    "medium": {
        "color": "#ffc107", "icon": "⚠️", "urgency": "moderate",
        "recommendation": "Exercise caution. Verify the source before taking any action.",
        "description": "The content has some suspicious characteristics that warrant attention.",
        "why_risky": "The content exhibits some patterns commonly found in phishing attempts.",
        "action_items": [
            "Do not enter personal information immediately",
            "Verify the source through independent means",
            "Check for spelling and grammar errors",
            "Look for secure connection indicators (HTTPS)",
            "Hover over links to see actual destination",
        ],
        "warning_signs": [
            "Mismatched URLs (hover to check destination)",
            "Poor spelling and grammar",
            "Requests for personal information",
            "Suspicious attachments",
        ],
        "tactics": [
            "Phishers often impersonate trusted organizations",
            "They create urgency to bypass critical thinking",
            "Legitimate companies rarely ask for passwords via email",
        ],
        "immediate": [
            "Stop and verify independently",
            "Contact the organization directly",
            "Do not click any links yet",
        ],
    },
    "high": {
        "color": "#dc3545", "icon": "🚨", "urgency": "high",
        "recommendation": "Avoid this link. This is likely a phishing attempt.",
        "description": "The content exhibits strong indicators of being a phishing attempt.",
        "why_risky": "The content strongly matches known phishing attack patterns.",
        "action_items": [
            "DO NOT click any links",
            "DO NOT provide any personal information",
            "DO NOT download any attachments",
            "Report to IT security if in workplace",
            "Delete the message",
            "Block the sender",
            "Run antivirus scan if already clicked",
        ],
        "warning_signs": [
            "Threats of account closure or suspension",
            "Immediate action required language",
            "Links to IP addresses instead of domains",
            "Fake login pages",
            "Unexpected financial requests",
        ],
        "tactics": [
            "Creating fake websites that look like legitimate services",
            "Using urgent language to pressure quick action",
            "Spoofing trusted brands and organizations",
            "Hiding malicious links behind legitimate-looking text",
            "Harvesting credentials through fake login forms",
        ],
        "immediate": [
            "Close browser/email immediately",
            "Do not enter any information",
            "Scan device for malware",
            "Change passwords if already entered",
            "Contact IT support if workplace-related",
        ],
    },
}
PREVENTION_TIPS = [
    "Keep software and browsers updated",
    "Use two-factor authentication when available",
    "Verify suspicious emails through independent channels",
    "Never provide passwords or sensitive info via email",
    "Be skeptical of urgent or threatening messages",
    "Check URLs carefully before clicking",
    "Use reputable antivirus software",
]
HELPFUL_RESOURCES = {
    "phishing_education": "Learn more about phishing at consumer.ftc.gov",
    "reporting": "Report phishing to the Anti-Phishing Working Group",
    "verification": "Always verify suspicious communications independently",
    "tools": "Use URL checkers and safe browsing tools",
}
THREAT_STEPS = [
    (0.2, "Minimal Threat"), (0.4, "Low Threat"), (0.6, "Moderate Threat"),
    (0.8, "High Threat"), (None, "Critical Threat"),
]
# Patterns that decide what is taken for a link: in mails, and the parts of a host name in chat messages.
MAIL_URL = r"https?://[a-zA-Z!$-_]+"
HOST_LABEL = "[a-zA-Z0-9][-a-zA-Z0-9]{0,62}"
TOP_LEVEL = "[a-zA-Z]{2,6}"
