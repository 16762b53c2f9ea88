"""Schemas of conversation rows, preference pairs and the run ledger."""

from __future__ import annotations

MESSAGE = "struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>,tool_call_id:string,name:string>"
MESSAGES = f"array<{MESSAGE}>"
JUDGE = "struct<score:double,criteria:map<string,int>,rationale:string,verdict:string>"
METADATA = f"struct<id:string,leaf_id:string,leaf_path:array<string>,difficulty:string,task_type:string,persona:string,style:string,adversarial:boolean,models:map<string,string>,judge:{JUDGE},flags:array<string>,answer:string,strategy:string,flaw:string>"

ROWS = f"id string, project_id string, prompt_id string, leaf_id string, run_id string, kind string, status string, prev_status string, filter_reason string, model_slug string, messages {MESSAGES}, tools string, metadata {METADATA}, score double, created_at double, updated_at double"
PAIRS = f"id string, project_id string, row_id string, run_id string, strategy string, flaw string, model_slug string, status string, rejected_messages {MESSAGES}, judge {JUDGE}, created_at double"
PROMPTS = "id string, project_id string, leaf_id string, run_id string, text string, persona string, style string, status string, adversarial boolean, noise double, embedding binary, created_at double"
TOPIC_NODES = "id string, project_id string, parent_id string, label string, slug string, difficulty string, task_type string, depth int, rows_per_leaf int, `order` int, is_negative boolean, is_leaf boolean"
RUNS = "id string, project_id string, status string, model_slug string, error_message string, stage int, done int, total int, errors int, refusals int, params string, spend_usd double, est_usd double, started_at double, finished_at double, created_at double"
RUN_ITEMS = "id string, run_id string, target_id string, status string, error string, payload string, attempts int"
RAW_CALLS = "id string, project_id string, run_id string, target_id string, model_slug string, provider string, error string, stage int, latency_ms int, request string, response string, usage string, cost_usd double, created_at double"
EVENTS = "run_id string, seq long, type string, payload string"

# Status lattices.
CANDIDATE = ("draft", "accepted", "edited", "flagged")
EXPORTABLE = ("draft", "accepted", "edited")
EXCLUDED = ("filtered", "refusal", "flagged")
REMOVED = ("filtered", "refusal")
