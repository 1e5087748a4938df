"""Explicit schemas of the record files; nothing is inferred at read time."""

SPECIFICATION = "struct<function_signature:string,preconditions:string,postconditions:string>"
TESTING = ("struct<external_functions:array<string>,visual_node_types:array<string>,"
           "textual_instance_types:array<string>,python_tests:array<string>,tests:string>")
TASKS = (f"prompts array<string>, task_id long, MBPP_task_id long, specification {SPECIFICATION}, "
         "external_functions array<string>, visual_node_types array<string>, "
         f"textual_instance_types array<string>, testing {TESTING}, flow_description string")

CHUNKS = "file string, chunk_id string, content string"

_RUN = ("experiment_name string, best_params_optimization string, temperature double, top_p double, "
        "top_k int, seed long, n_generations_per_task int, model string, largest_context long, ")
RUNS = _RUN + "task_candidates map<string,array<string>>"
REFINED = ("struct<task_id:string,n:int,refinements_performed:int,initial_error_category:string,"
           "initial_error_msg:string,initial_code_candidate:string,final_error_category:string,"
           "final_error_msg:string,final_code_candidate:string>")
REFINED_RUNS = _RUN + f"task_candidates map<string,array<{REFINED}>>"
MALFORMED_RUNS = _RUN + "task_candidates map<string,variant>"

CATALOG = ("type string, function_name string, module_path string, doc string, body string, types string")
