-- Text that is no date is no current day.
SELECT *
FROM {forecast}
WHERE try_to_date(date_str, 'yyyy/MMM/dd') >= CAST(:as_of AS DATE)
