"""Schemas of the engine's tables."""

WORKFLOWS = "id long, name string, created_at timestamp"
RUNS = "id long, workflow_id long, workflow_name string, status string, input string, output string, started_at timestamp, finished_at timestamp, error string"
STEPS = "id long, run_id long, step_key string, input_hash string, status string, output string, error string, started_at timestamp, finished_at timestamp"
EVENTS = "id long, run_id long, step_id long, event_type string, message string, data string, created_at timestamp"
POINTS = "run_id long, step_id long, metric_name string, metric_value double, unit string, created_at timestamp, ord long"

RUN_STATUS = ("running", "completed", "failed", "canceled")
STEP_STATUS = ("running", "completed", "failed")
