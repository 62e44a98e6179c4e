"""Schemas of the stored tables."""

from __future__ import annotations

IMAGES = (
    "filename string, score double, rating_mu double, rating_sigma double, comparison_count int, "
    "last_compared_at timestamp, ranking_generation int, prompt_tags string"
)
COMPARISONS = "id long, filename_a string, filename_b string, winner string, timestamp timestamp, weight double, transitive_depth int"
META = "key string, value string"
HISTORY = "array<struct<timestamp:timestamp,comparison_id:long,other:string,opponent_score:double,winner:boolean,weight:double,transitive_depth:int>>"
SPLIT = "vector_name string, id string, raw string, vector array<float>"
VECTORS = "id string, vector array<float>"
TERM = "struct<term:string,weight:double,idx:int>"
BOX = "array<struct<x:double,y:double,width:double,height:double,confidence:double>>"
LANDMARKS = "array<struct<x:double,y:double,z:double,visibility:double>>"
RATING = "struct<mu:double,sigma:double>"
