"""Column roles and benign defaults of the payments schema, and projections by role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Which columns identify a payment and which label it. Neither may reach a model.
META = ["txn_id", "timestamp", "customer_id", "payer_account_id", "payee_account_id", "merchant_id", "device_id"]
LABEL = ["is_fraud", "fraud_type", "attack_vector_id", "campaign_id", "mule_ring_id", "is_hard_negative", "evasion_applied"]
# The guards' outputs, and the columns a payment message carries, by part of the message.
GUARDS = ["agent_injection_score", "agent_injection_flag", "intent_guard_blocked", "intent_guard_stepup", "intent_guard_violation_count",
          "agent_control_blocked", "agent_control_stepup", "vishing_score", "vishing_flag", "media_artefact_score", "media_artefact_flag"]
OBSERVABLE = {
    "instruction": "rail channel amount currency amount_inr is_cross_border mcc payee_psp payer_psp is_irrevocable_rail iso20022_remittance_len"
                   " iso20022_field_entropy iso20022_unstructured_ratio",
    "auth": "auth_method auth_attempts auth_latency_ms step_up_triggered mfa_passed otp_delivery_delay_s recent_credential_change_h sim_swap_recency_days",
    "device": "device_age_days device_is_new device_is_emulator device_is_rooted screen_share_active remote_access_app_detected"
              " accessibility_service_active call_in_progress vpn_or_proxy ip_asn_is_hosting ip_country_mismatch geo_velocity_kmh distance_from_home_km"
              " session_duration_s app_backgrounded_count",
    "behaviour": "keystroke_flight_mean_ms keystroke_flight_cv typing_burstiness pointer_entropy form_fill_duration_s payee_field_pasted hesitation_events"
                 " amount_field_corrections biometric_match_score voice_match_score liveness_score doc_ocr_confidence",
    "payee": "payee_age_days payee_added_minutes_ago payee_is_first_time payee_account_age_days payee_inbound_unique_payers_24h payee_inbound_amount_24h"
             " payee_outbound_ratio_24h payee_name_match_score payee_name_homoglyph_flag payee_prior_txn_count payee_is_high_risk_category",
    "agentic": "initiated_by_agent agent_is_registered agent_identity_asserted agent_request_signature_valid agent_reputation intent_token_present"
               " intent_signature_valid intent_amount_delta_ratio intent_payee_match intent_age_s agent_tool_calls agent_untrusted_content_tokens"
               " spt_scope_violation spt_reuse_count merchant_is_agent_optimised merchant_domain_age_days",
    "customer": "customer_tenure_days customer_age_band_ord customer_digital_literacy customer_is_corporate account_balance_ratio kyc_level prior_fraud_reports",
    "time": "hour day_of_week is_night is_salary_window",
}
CATEGORICAL = ["rail", "channel", "currency", "mcc", "payee_psp", "payer_psp", "auth_method"]
OBSERVED = {c for names in OBSERVABLE.values() for c in names.split()}
DEFAULTS = {"amount": 0.0, "rail": "upi", "channel": "app", "currency": "INR", "auth_attempts": 1, "payee_name_match_score": 1.0}


def input_columns(df: DataFrame) -> list[str]:
    """Model inputs: columns of a payment message, derived ``f_`` and ``g_`` columns and guard outputs; nothing else gets in."""
    banned = set(META) | set(LABEL)
    return [c for c in df.columns if c not in banned and (c in OBSERVED or c in GUARDS or c.startswith(("f_", "g_")))]


def column_layers(df: DataFrame) -> dict[str, list[str]]:
    """Four cumulative layers: raw, + window features, + graph features, + guards."""
    cols = input_columns(df)
    raw = [c for c in cols if not c.startswith(("f_", "g_")) and c not in GUARDS]
    window = raw + [c for c in cols if c.startswith("f_")]
    graph = window + [c for c in cols if c.startswith("g_")]
    return {"raw": raw, "raw+window": window, "raw+window+graph": graph, "raw+window+graph+guards": graph + [c for c in cols if c in GUARDS]}


def align_request(df: DataFrame, known: list[str], derived_prefixes=("f_", "g_")) -> DataFrame:
    """Unknown columns are refused; missing raw columns take defaults, missing derived ones stay NULL."""
    unknown = [c for c in df.columns if c not in known]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    filled = [F.coalesce(F.col(c), F.lit(DEFAULTS.get(c))) if c in df.columns and c in DEFAULTS else
              F.col(c) if c in df.columns else
              F.lit(None if c.startswith(derived_prefixes) else DEFAULTS.get(c)) for c in known]
    return df.select(*[f.alias(c) for f, c in zip(filled, known)])
