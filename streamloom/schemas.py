"""Record types of the trip, fare, vehicle and trade streams."""

#: DDL, as readers, createDataFrame and stateful processors take it.
RIDE = "ride_id long, is_start boolean, start_time timestamp, end_time timestamp, start_lon float, start_lat float, end_lon float, end_lat float, passenger_cnt short, taxi_id long, driver_id long"
FARE = "ride_id long, taxi_id long, driver_id long, start_time timestamp, payment_type string, tip float, tolls float, total_fare float"
CAR_EVENT = "id string, car_id string, event_time timestamp, longitude float, latitude float, consumption float, speed float, throttle float, engine_load float"
CUSTOMER = "event_time timestamp, customer_id long, customer_info string"
TRADE = "event_time timestamp, customer_id long, trade_info string"
ENRICHED_TRADE = "trade struct<event_time:timestamp,customer_id:long,trade_info:string>, customer struct<event_time:timestamp,customer_id:long,customer_info:string>"
SEGMENT = "start_time timestamp, length int, max_speed int, erraticness float"
TAXI_QUERY = "query_id long, longitude float, latitude float, asked_at timestamp"
