"""Fixed values.

These lists, tables and texts must hold exactly these values for results to be
right: domain vocabularies, thresholds and the prompt texts. They are data, not logic.
"""

# --- regions and areas -------------------------------------------------------

HK_DISTRICTS = [
    "Central and Western", "Wan Chai", "Eastern", "Southern",
    "Yau Tsim Mong", "Sham Shui Po", "Kowloon City", "Wong Tai Sin",
    "Kwun Tong", "Tsuen Wan", "Tuen Mun", "Yuen Long", "Sha Tin",
    "Tai Po", "Sai Kung", "Kwai Tsing", "North", "Islands",
]
MACAU_DISTRICTS = ["Macau Peninsula", "Taipa", "Cotai", "Coloane"]
DISTRICTS = HK_DISTRICTS + MACAU_DISTRICTS

# "Coloane" is a district but belongs to no area: it stands for itself.
AREAS = {
    "HK Island": ["Central and Western", "Eastern", "Southern", "Wan Chai", "Islands"],
    "Kowloon": ["Kowloon City", "Kwun Tong", "Sham Shui Po", "Wong Tai Sin", "Yau Tsim Mong"],
    "New Territories": ["Kwai Tsing", "North", "Sai Kung", "Sha Tin", "Tai Po",
                        "Tsuen Wan", "Tuen Mun", "Yuen Long"],
    "Macau": ["Cotai", "Macau Peninsula", "Taipa"],
}

# --- claims ------------------------------------------------------------------

PROVIDER_TYPES = {
    "hospital": 20, "clinic": 25, "specialist": 15, "pharmacy": 10, "dental": 8,
    "physiotherapy": 6, "optical": 4, "repair_shop": 5, "legal": 4, "lab": 3,
}
RISKY_PROVIDER_TYPES = ["repair_shop", "legal"]
CLAIM_TYPES = {"medical": 35, "travel": 20, "motor": 20, "property": 15, "life": 10}
CHANNELS = {"online_portal": 35, "mobile_app": 25, "branch": 15, "agent": 15, "email": 10}

# --- thresholds: (lower bound, label), highest first, inclusive --------------

PROVIDER_TIERS = [(25, "critical"), (15, "high"), (8, "medium")]
SCORE_CATEGORIES = [(75, "critical"), (50, "high"), (25, "medium")]
LOWEST_BAND = "low"

# Rule score: (strictly greater than, points) and (at most, points).
BASE_POINTS = 10.0
AMOUNT_POINTS = [(500_000, 30), (200_000, 20), (100_000, 10)]
FLAGGED_PCT_POINTS = [(50, 25), (30, 15), (15, 8)]
DAYS_POINTS = [(2, 10), (5, 5)]
CHANNEL_POINTS = {"email": 8, "agent": 5}
CLAIM_TYPE_POINTS = {"travel": 5, "property": 5}

# Risk factors: name, impact and description around the claim's own value, or values.
FACTOR_HIGH_AMOUNT = ("High Claim Amount", "high", "Claim amount of HKD ", " exceeds the 90th percentile threshold.")
FACTOR_AMOUNT = ("Elevated Claim Amount", "medium", "Claim amount of HKD ", " is above average for ", " claims.")
FACTOR_HISTORY = ("Provider History", "high", "Provider has ", "% flagged claims, significantly above the 10% baseline.")
FACTOR_WATCH_LIST = ("Provider Watch List", "medium", "Provider flagged claims rate (", "%) is above normal range.")
FACTOR_RAPID = ("Rapid Processing", "medium", "Claim processed in ", " day(s) — unusually fast turnaround.")
FACTOR_CHANNEL = (
    "Submission Channel", "low", "Claims via '", "' have a higher fraud incidence rate than digital channels.")
FACTOR_STANDARD = ("Standard Profile", "low", "No significant risk indicators detected for this claim.")

# --- security ----------------------------------------------------------------

INCIDENT_TYPES = {
    "phishing": 35, "malware": 15, "unauthorized_access": 12, "brute_force": 10,
    "data_exfiltration": 8, "insider_threat": 7, "ransomware": 7, "ddos": 6,
}
SEVERITY_RANKS = {"critical": 1, "high": 2, "medium": 3, "low": 4}
SOURCE_COUNTRIES = {
    "CN": 30, "RU": 20, "US": 15, "KR": 10, "IN": 5,
    "BR": 5, "IR": 5, "NG": 4, "VN": 3, "UA": 3,
}
TARGET_SYSTEMS = [
    "claims_portal", "policy_admin", "customer_db", "email_gateway",
    "hr_system", "payment_gateway", "data_warehouse",
]
DETECTION_METHODS = {
    "SIEM": 35, "automated_scan": 25, "anomaly_detection": 20,
    "user_report": 12, "threat_intel": 8,
}
INCIDENT_STATUSES = {
    "resolved": 40, "mitigated": 25, "investigating": 15, "escalated": 10, "closed": 10,
}
UNRESOLVED_STATUSES = ["investigating", "escalated"]
# The KPI tile asks for these two; no incident ever has status "open".
KPI_OPEN_STATUSES = ["open", "investigating"]
BREACH_PROBABILITY = {"data_exfiltration": 0.6, "insider_threat": 0.6, "ransomware": 0.3}
BREACH_PROBABILITY_ELSE = 0.05
ALERT_SOURCES = {"firewall": 25, "endpoint": 20, "iam": 15, "email_filter": 20, "waf": 10, "ids": 10}
ALERT_TYPES = {
    "intrusion_attempt": 15, "malware_detected": 15, "suspicious_login": 20,
    "policy_violation": 10, "anomalous_traffic": 15, "phishing_email": 10,
    "privilege_escalation": 7, "data_transfer": 8,
}
ALERT_STATUSES = {
    "new": 15, "acknowledged": 20, "investigating": 15, "resolved": 35, "false_positive": 15,
}

# --- retrieval and prompts ---------------------------------------------------

RETRIEVAL_DEPTH = 5
NUMBERED_CONTEXT_DEPTH = 4
HISTORY_LIMIT = 10
PREVIEW_LENGTH = 200
CONTEXT_SEPARATOR = "\n\n---\n\n"
NO_RESULT_SOURCE = "System"
NO_RESULT_TEXT = "Vector search is not available. Please ensure the index is configured."
CHAT_SYSTEM_PROMPT = """You are a compliance and risk policy assistant for a major insurance company in Hong Kong.
You answer questions about fraud policies, security protocols, incident response procedures, regulatory requirements, and claims documentation standards.
Use ONLY the provided context to answer. If the context does not contain enough information, say so clearly.
Be concise, professional, and cite the relevant policy sections when possible."""
CHAT_PROMPT_HEAD = "Context from policy documents:\n\n"
CHAT_PROMPT_QUESTION = "\n\n---\n\nUser question: "
CHAT_PROMPT_TAIL = (
    "\n\nProvide a clear, well-structured answer based on the context above. "
    "Reference specific policy sections where applicable."
)
CITED_SYSTEM_PROMPT = """You are a Risk Policy Compliance Copilot for an insurance company operating in Hong Kong and Macau.
Answer questions accurately based ONLY on the provided policy document context.
Always cite the specific document and section you are referencing.
If the context does not contain enough information to fully answer the question, say so clearly.
Be concise but thorough. Use bullet points for lists of requirements or thresholds."""
CITED_PROMPT_HEAD = "Context from internal policy documents:\n\n"
CITED_PROMPT_QUESTION = "\n\n---\n\nQuestion: "
CITED_PROMPT_TAIL = (
    "\n\nPlease provide a detailed answer with specific thresholds, procedures, and source citations."
)

# --- learning ----------------------------------------------------------------

CATEGORICAL_FEATURES = ["claim_type", "prov_type", "region", "submission_channel", "risk_tier"]
FEATURES = [
    "claim_amount_hkd", "processing_days", "claim_type", "prov_type", "region",
    "submission_channel", "flagged_claims_pct", "risk_tier",
]
TEST_SHARE_PERCENT = 20
SEED = 42
