SELECT *
FROM {forecast}
