"""Word lists that decide results, as plain values.

``{org}`` stands for the organization's own name, which the caller supplies.
"""

# Phrases that mark a drafting task.
DRAFT_SIGNALS = [
    "draft", "write", "generate", "article", "linkedin", "post",
    "magazine", "press release", "news story", "feature story",
    "create content", "create article",
]

# Phrases that mark a question about news.
NEWS_SIGNALS = [
    "event", "ceremony", "graduation", "mou", "agreement", "signed",
    "collaboration", "drill", "competition", "award", "visit",
    "workshop", "conference", "seminar", "celebration",
    "achievement", "activity", "highlights", "recap", "announcement",
    "hosted", "welcomed", "completed", "launched", "held", "attended",
    "sinopec", "samsung", "nesma", "saudi aramco", "sabic",
    "ojt", "on-the-job", "intake", "job fair",
    "recent", "latest", "this year", "2024", "2025", "2026",
]

# Phrases that mark a question about the organization itself.
KNOWLEDGE_SIGNALS = [
    "what is {org}", "who is {org}", "about {org}",
    "mission", "vision", "history", "established", "founded",
    "accreditation", "certification", "iso", "abet", "ncaaa",
    "program", "course", "curriculum", "short course",
    "methodology", "training approach", "campus", "facility", "facilities",
    "faq", "frequently asked",
    "describe {org}", "explain {org}", "overview",
    "institutional", "governance", "strategy", "strategic",
    "brand", "editorial style", "credential", "qualification",
    "who are", "tell me about {org}",
]


def route_signals(org: str) -> list[tuple[str, str]]:
    """``(kind, phrase)`` rows for one organization."""
    lists = [("draft", DRAFT_SIGNALS), ("news", NEWS_SIGNALS), ("knowledge", KNOWLEDGE_SIGNALS)]
    return [(kind, phrase.replace("{org}", org.lower())) for kind, phrases in lists for phrase in phrases]
