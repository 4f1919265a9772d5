"""Time queries one by one, printing as they finish: python tools/time_queries.py SF NAME..."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidewatch.plans import QUERIES, load_all  # noqa: E402
from tidewatch.session import local_session  # noqa: E402

load_all()
spark = local_session(8)
for name in sys.argv[2:]:
    t0 = time.perf_counter()
    QUERIES[name](spark, f"/root/testdata/sf{sys.argv[1]}").write.format("noop").mode("overwrite").save()
    print(f"{name} {time.perf_counter() - t0:.1f}s", flush=True)
