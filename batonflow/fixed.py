"""Rules of the domain that results depend on, as data."""

from __future__ import annotations

# Enumerations.
STAGES = ["sales", "product", "engineering", "customer_success", "leadership"]
TYPES = ["requirement", "decision", "commitment", "constraint", "dependency", "problem", "resolution", "question"]
STATUSES = ["candidate", "active", "conflicting", "superseded", "stale", "ignored"]
JOB_STATUSES = ["queued", "running", "done", "failed", "poison"]
SOURCE_KINDS = ["slack", "email", "drive", "call"]
SPEAKERS = {"CUSTOMER": "customer", "SALES": "sales", "PRODUCT": "product", "ENGINEERING": "engineering", "CS": "other"}

# severity = importance x authority x outcome; bands from 2 and from 1 on.
IMPORTANCE = {"critical": "3", "high": "2", "normal": "1"}
AUTHORITY = {4: "1.0", 3: "0.8", 2: "0.6", 1: "0.3", 0: "0.1"}
OUTCOME = {"object_missing": "1.0", "contradicted": "1.0", "stale_reference": "0.9", "missing": "0.9", "generalized": "0.6"}

# What generalises what, which values mean the same, and the sub-key that stands for a nested slot.
CAPABILITY_CHILDREN = {"sso": ["saml", "oidc"]}
REGION_MEMBERS = {
    "eu": ["eu-west-1", "eu-central-1", "eu-north-1", "eu-west-2"],
    "us": ["us-east-1", "us-east-2", "us-west-1", "us-west-2"],
}
SYNONYMS = {"protocol": [["saml", "saml2", "saml 2.0", "saml-based sso"]]}
PRECISION = {"day": 0, "month": 1, "quarter": 2}
NESTED_KEY = {"impact": "data_loss", "sla_impact": "breached", "time_window": "start"}
SLOT_KIND = {
    "protocol": "specificity", "idp": "dependency", "due_date": "deadline", "priority": "priority",
    "acceptance_criteria": "acceptance", "rationale": "rationale", "region": "constraint", "quantity": "specificity",
    "integrations": "dependency", "plan": "specificity", "impact": "incident", "time_window": "incident",
    "root_cause": "incident", "sla_impact": "incident", "remediation": "incident", "extra": "specificity",
}

# Pairs of stances that conflict, in either order; every other pair doesn't.
CONFLICTING_STANCES = [
    ("required", "deferred"), ("required", "dropped"), ("deferred", "in_progress"), ("deferred", "done"), ("in_progress", "dropped"),
]

# Upstream and downstream stages that lineage links.
STAGE_PAIRS = [
    ("sales", "product"), ("product", "engineering"), ("sales", "customer_success"),
    ("engineering", "sales"), ("engineering", "customer_success"),
]

# Capabilities that are confirmed from the start.
CAPABILITIES = ["sso", "scim", "audit_logs", "data_residency", "rbac", "api_access", "uptime_sla", "pricing", "integration", "onboarding", "seats", "incident"]

# Thresholds.
SAME_NAME, NEAR_NAME = 0.85, 0.6
SAME_TEXT, NEAR_TEXT = 0.92, 0.80
SURE = 0.6
CORRECTION = 0.7
MAX_ATTEMPTS = 3
STALE_SECONDS = 600
INCIDENT_HOURS = 72

# Hand-off contracts, (id, from, to, fields of (name, check, types, slots, importance, least authority, rule)).
CONTRACTS = [
    ("sales_to_product", "sales", "product", [
        ("requirements", "propagate", ["requirement"], ["protocol", "idp", "due_date", "priority", "extra"], "critical", 2, None),
        ("commitments", "propagate", ["commitment"], ["due_date"], "high", 0, None),
        ("constraints", "propagate", ["constraint"], [], "high", 0, None),
        ("problem", "propagate", ["problem"], [], "normal", 0, None),
        ("evidence", "present", ["requirement"], [], "high", 0, "has_derived_from"),
    ]),
    ("product_to_engineering", "product", "engineering", [
        ("requirements", "propagate", ["requirement"], ["protocol", "idp", "due_date", "priority", "extra"], "critical", 0, None),
        ("decisions", "propagate", ["decision"], ["rationale"], "high", 0, None),
        ("dependencies", "propagate", ["dependency"], [], "high", 0, None),
        ("constraints", "propagate", ["constraint"], [], "high", 0, None),
        ("acceptance_criteria", "present", ["requirement"], ["acceptance_criteria"], "high", 0, None),
    ]),
    ("sales_to_customer_success", "sales", "customer_success", [
        ("requirements", "propagate", ["requirement", "constraint"], ["region", "quantity", "integrations", "plan", "due_date"], "critical", 0, None),
        ("commitments", "propagate", ["commitment"], ["due_date", "plan"], "critical", 0, None),
        ("contacts", "present", ["dependency"], [], "normal", 0, "has_customer_contact"),
    ]),
    ("engineering_to_customer_facing::sales", "engineering", "sales", [
        ("incident", "propagate", ["problem"], ["impact", "time_window", "root_cause", "sla_impact"], "critical", 0, None),
        ("resolution", "propagate", ["resolution"], ["remediation", "due_date"], "high", 0, None),
    ]),
    ("engineering_to_customer_facing::customer_success", "engineering", "customer_success", [
        ("incident", "propagate", ["problem"], ["impact", "time_window", "root_cause", "sla_impact"], "critical", 0, None),
        ("resolution", "propagate", ["resolution"], ["remediation", "due_date"], "high", 0, None),
    ]),
    ("engineering_to_product", "engineering", "product", [
        ("constraints", "propagate", ["constraint"], ["rationale", "due_date"], "critical", 0, None),
        ("problems", "propagate", ["problem"], [], "high", 0, None),
    ]),
    ("leadership_to_product", "leadership", "product", [
        ("decisions", "propagate", ["decision"], ["rationale", "priority", "due_date"], "critical", 0, None),
        ("commitments", "propagate", ["commitment"], ["due_date"], "high", 0, None),
    ]),
    ("leadership_to_sales", "leadership", "sales", [
        ("policy_decisions", "propagate", ["decision"], ["rationale", "plan"], "critical", 0, None),
        ("commitments", "propagate", ["commitment"], ["due_date", "plan"], "high", 0, None),
    ]),
]
