"""The values that define the results, stated for the SQL apart from the engine's own: a wrong value there shows as a difference."""

from __future__ import annotations

# Word lists, patterns, limits and wording.
ANSWER_TEMPLATE = """Answer from the sources below and from nothing else. If they don't hold the answer, say so. Be brief, keep units, and don't mention how the sources were found.
{facts}
Sources:
{context}

Question: {question}
Answer:"""
FACT_NOTE = """The question asks for a value. Give it only if one source states it for the very thing and period that the question names; never join a number of one statement with the subject of another.
"""
REWRITE_TEMPLATE = """Make the last question understandable without the conversation. Put names in place of pronouns, keep scheme names as they are, add nothing and don't answer. Reply with the question only.

Conversation:
{history}

Question: {question}
Standalone question:"""
MIN_DOCUMENT_CHARS = 30
CONTENT_TERMS = (
    "how much", "how many", "number", "total", "amount", "quantity", "percentage", "percent", "rate", "insured", "insurance", "coverage", "covered",
    "beneficiaries", "beneficiary", "financial year",
)
FACT_KEYWORDS = (
    "achieved", "allocated", "amount", "approved", "beneficiaries", "beneficiary", "cost", "coverage", "covered", "financial year", "fund",
    "funding", "fy", "how many", "how much", "insurance", "insured", "number", "percent", "percentage", "quantity", "rate", "sanctioned", "spent",
    "target", "total", "year",
)
FACT_PATTERN = r"\bfy\s*20\d{2}\b|\bfinancial year\b|\b\d+(?:\.\d+)?\s*(?:lakh|crore|million|billion|percent)?\b"
PROMPT_KEYWORDS = (
    "how much", "how many", "what percentage", "what percent", "what is the amount", "what was the amount", "what is the number",
    "what was the number", "total number", "total amount", "number of", "amount of", "percentage of", "in financial year", "financial year", "fy ",
    "year ", "during 2024", "during 2025", "during 2026", "insured", "beneficiaries", "beneficiaries covered", "coverage",
)
CAPACITY = r"(?i)(\b\d+(?:\.\d+)?\s*(?:MT|MTPD|KG|KGS|TON|TONS|LITRE|LITRES|L|KL|MW|KW)\b)"
COMMON_HEADINGS = (
    "application procedure", "application process", "assistance", "background", "beneficiaries", "benefits", "checklist of documents", "conclusion",
    "conditions", "coverage", "credit facility", "documents", "documents required", "duration", "eligibility", "eligibility criteria",
    "eligible activities", "eligible beneficiaries", "eligible projects", "eligible projects for all beneficiaries",
    "eligible projects for building community farming assets", "financial assistance", "financial support", "funding", "funding pattern",
    "guidelines", "how to apply", "implementation", "implementation mechanism", "intended beneficiaries", "interest subsidy", "interest subvention",
    "introduction", "loan assistance", "monitoring", "monitoring mechanism", "objective", "objectives", "overview", "project activities",
    "project components", "project cost", "related resources", "scheme duration", "scheme objective", "scheme period", "scope", "support",
    "target beneficiaries", "terms and conditions",
)
LETTERED = r"^\s*[A-Z][.)]\s+[A-Za-z]"
LOWER_LETTERED = r"^\s*[a-z][.)]\s+[A-Za-z]"
MONEY = r"(?i)(₹?\s*[0-9]+(?:\.[0-9]+)?\s*(?:crore|crores|lakh|lakhs|lac|lacs|rs\.?|rupees)?)"
NUMBERED = r"^\s*\d+[.)]\s+[A-Za-z]"
PERCENT = r"(?i)(\b\d+(?:\.\d+)?\s*%)"
ROMAN = (
    "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi",
)
SUBNUMBERED = r"^\s*\d+(?:\.\d+)+[.)]?\s+[A-Za-z]"
TABLE_KEYWORDS = (
    "item", "items", "activity", "activities", "cost norms", "cost norm", "financial assistance", "assistance", "amount", "subsidy", "percentage",
    "project", "per unit", "per project", "warehouse", "warehouses", "silos", "pack house", "pack houses", "cold storage", "cold chain", "logistics",
    "processing", "ripening", "assaying", "sorting", "grading",
)
