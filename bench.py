"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from meridia.plans import catalog

HEADLINE = (
    "nearest_edge", "edge_speed_median", "traffic_flow", "route_traffic", "geofence_check", "region_locate", "places_nearby", "places_text", "tile_of_point", "line_length",
    "node_degree", "components", "shortest_path_costs", "street_intersections", "noding", "ingest_dedupe", "sync_push", "feed_page", "run_length_steps", "gap_smoothing",
    "search_fold_tokens", "search_ranked", "reverse_geocode", "street_rollup", "neighbourhood_groups", "population_by_area", "poi_classify", "tile_zoom_explode", "label_grid_topn", "raster_pyramid",
    "version_updates", "traffic_cells", "traffic_cells_box", "typical_fixes", "activity_cells", "track_lengths", "track_thinned", "trip_latest_fix", "places_favourites", "tpch_join_agg", "cube_rollup_sales",
    "route_paths", "stored_routes", "dead_end_joins", "merged_streets", "fence_validity", "raster_holes",
)

if __name__ == "__main__":
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
