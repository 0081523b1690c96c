"""Fixed values that results depend on: patterns, word lists, thresholds and texts."""

# Wording of running page furniture, anchored, in any case.
BOILERPLATE = (
    r"(?iu)^(?:Page\s+\d+\s*/\s*\d+|Page\s+\d+|Version\s+[\d.]+|Classification:\s+|CONFIDENTIAL$"
    r"|This document is the property|Unauthorized\s+distribut|Effective:\s+)"
)

# Words that leave a clause open.
TRAILING_WORDS = (
    "of", "for", "in", "to", "with", "from", "by", "at", "on", "into", "about", "between", "through", "within", "without", "including",
    "the", "a", "an", "all", "any", "each", "every", "this", "that", "and", "or", "nor", "but",
    "be", "is", "are", "was", "were", "been", "being", "must", "shall", "should", "will", "would", "can", "could", "may", "not", "also", "than",
)

# Descriptions of governance requirements.
META_ALL = r"(?is)all\s+security\s+policies\s+and\s+operational\s+procedures.*(?:documented|kept\s+up\s+to\s+date|in\s+use|known\s+to\s+all)"
META_ROLES = r"(?i)roles\s+and\s+responsibilities\s+for\s+performing\s+activities\s+in\s+requirement"

# Instruction before embedded queries.
QUERY_PREFIX = "Retrieve policy documentation that provides evidence of compliance with this security control requirement: "

# Concepts and the terms that widen a query, in order.
EXPANSIONS = [
    ("information at rest", "encryption, AES, TDE, full-disk encryption, data-at-rest, disk encryption, database encryption, storage encryption, encrypted at rest, data protection"),
    ("information in transit", "TLS, SSL, HTTPS, transport encryption, VPN, IPsec"),
    ("cryptographic protection", "encryption, key management, PKI, certificate, AES"),
    ("audit events", "logging, SIEM, log retention, audit trail, event monitoring"),
    ("flaw remediation", "patching, vulnerability management, CVE, security update"),
    ("access enforcement", "RBAC, ACL, permissions, authorization, least privilege"),
    ("incident response", "breach notification, forensics, incident handling, CSIRT"),
    ("risk assessment", "risk analysis, threat modeling, vulnerability assessment"),
    ("system monitoring", "IDS, IPS, intrusion detection, network monitoring, SIEM"),
    ("boundary protection", "firewall, DMZ, network segmentation, NSC, perimeter"),
    ("information flow", "data flow, network flow, ACL, firewall rules, flow control, flow enforcement, data transfer, cross-domain"),
    ("physical access", "badge, biometric, door lock, visitor escort, card reader, facility access, building entry, physical security"),
    ("physical access control", "badge reader, security camera, visitor sign-in, escort, two-factor entry, biometric scanner, server room access, entry point, building access"),
    ("policy and procedures", "policy document, security procedures, disseminate, document, develop policy, maintain policy, policy review"),
    ("maintenance", "maintenance activities, scheduled maintenance, authorized personnel, maintenance tools, maintenance records, preventive maintenance, system maintenance, hardware maintenance"),
    ("system and services acquisition", "acquisition contracts, vendor compliance, security requirements, procurement, supply chain, third-party assessment"),
    ("system and communications protection", "network security architecture, secure communication, boundary protection, TLS, communication protocols, network security, data in transit"),
    ("flow enforcement", "network segmentation, firewall rules, information flow, data flow control, transfer gateway, traffic inspection, cross-domain, security domain"),
    ("terminated", "termination, revoke access, deprovisioning, offboarding, departure, disabled account, end of employment, access removal"),
    ("revoked", "revoke, disable, deactivate, remove access, deprovisioning, access termination, account disable"),
    ("shared", "group ID, generic account, shared credential, common password, shared authentication, group account, service account"),
    ("user id", "user identification, unique identifier, account identity, login credential, authentication identity, user account"),
    ("roles and responsibilities", "role assignment, job function, duty assignment, personnel responsibility, staff accountability, RACI, segregation of duties"),
    ("documented", "documentation, written policy, formal procedure, recorded, established, published, maintained, kept up to date, disseminate"),
]

# Retrieval and judging.
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
MIN_SCORE = 0.55
CONFIDENCE_FLOOR = 0.7
LEVELS = {"fully_compliant": 3, "partially_compliant": 2, "non_compliant": 1}

# Messages for answers that can't be used, each with what would be needed.
ZERO_CONFIDENCE = ("Zero-confidence rationale.", "Policy text directly addressing the control.")
UNKNOWN_TYPE = ("Invalid LLM output: unknown response type.", "Response must be MappingRationale or InsufficientEvidence.")
MISSING_ELEMENT = ("Missing batch element in LLM response.", "One evaluation per chunk.")
NO_OBJECT = ("Invalid batch element: not a JSON object.", "Each element must be a valid JSON object.")
UNPARSED_ELEMENT = ("Failed to parse batch element.", "A valid MappingRationale or InsufficientEvidence.")
RETRIES_SPENT = ("Invalid LLM output after retries.", "A well-formed JSON response from the LLM.")

# Explanations of verdicts taken from siblings, and of corrected ones.
SIBLINGS_NONE = "Inferred from sibling controls: all <<n>> evaluated controls in Requirement <<family>> are non-compliant (<<ids>>). This governance requirement cannot be met."
SIBLINGS_FULL = "Inferred from sibling controls: all <<n>> evaluated controls in Requirement <<family>> are compliant. Aggregated confidence from sibling assessments."
SIBLINGS_MIXED = "Inferred from sibling controls: <<full>> of <<n>> evaluated controls in Requirement <<family>> are fully compliant. Gaps remain in <<ids>>."
COMBINED_ALL = "Combined evidence from <<chunks>> chunks covers all <<n>> sub-requirements: <<texts>>"
COMBINED_SOME = "Combined evidence from <<chunks>> chunks covers <<covered>>/<<n>> sub-requirements. Missing: <<texts>>"
