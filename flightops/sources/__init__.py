from flightops.sources.flights import (  # noqa: F401
    read_carriers, read_flight_rejects, read_flights, with_flight_id,
)
from flightops.sources.requests import (  # noqa: F401
    parse_csv_requests, parse_json_requests, split_bad_requests,
)
