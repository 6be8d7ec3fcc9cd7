"""Booking schema and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw booking record (14 columns). Times are wall-clock TIMESTAMP_NTZ so
# results never depend on the session time zone.
BOOKING = T.StructType([
    T.StructField("Booking_ID", T.LongType(), False),
    T.StructField("Customer_ID", T.LongType(), True),
    T.StructField("Service_Type", T.StringType(), True),
    T.StructField("Branch", T.StringType(), True),
    T.StructField("Booking_Time", T.TimestampNTZType(), True),
    T.StructField("Appointment_Time", T.TimestampNTZType(), True),
    T.StructField("Booking_Lead_Time_Days", T.IntegerType(), True),
    T.StructField("Past_Visit_Count", T.IntegerType(), True),
    T.StructField("Past_Cancellation_Count", T.IntegerType(), True),
    T.StructField("Past_No_Show_Count", T.IntegerType(), True),
    T.StructField("Payment_Method", T.StringType(), True),
    T.StructField("Day_of_Week", T.StringType(), True),
    T.StructField("Customer_Latent_Risk", T.DoubleType(), True),
    T.StructField("Outcome", T.StringType(), True),
])

# Same record with the two times still as text (CSV / JSON payloads).
BOOKING_RAW = T.StructType([
    T.StructField(f.name, T.StringType(), True) if f.name in ("Booking_Time", "Appointment_Time") else f
    for f in BOOKING.fields
])

DATETIME_COLUMNS = ["Booking_Time", "Appointment_Time"]
CATEGORICAL_COLUMNS = ["Service_Type", "Branch", "Payment_Method", "Day_of_Week", "Outcome"]
NUMERIC_COLUMNS = ["Booking_Lead_Time_Days", "Past_Visit_Count", "Past_Cancellation_Count", "Past_No_Show_Count"]
ID_COLUMNS = ["Booking_ID", "Customer_ID"]
ENCODED_COLUMNS = ["Service_Type", "Branch", "Payment_Method", "Day_of_Week"]

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------
SERVICES = ["Bridal Makeup", "Facial", "Hair Coloring", "Hair Spa", "Haircut", "Manicure", "Pedicure"]
BRANCHES = ["Bangalore_Indiranagar", "Chennai", "Delhi_CP", "Mumbai_Andheri", "Mumbai_Bandra", "Pune_KP", "Surat"]
PAYMENTS = ["Card", "Cash", "UPI", "Wallet"]
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

SERVICE_TIER = {
    "Bridal Makeup": "premium",
    "Hair Coloring": "premium",
    "Hair Spa": "premium",
    "Haircut": "standard",
    "Facial": "standard",
    "Pedicure": "standard",
    "Manicure": "standard",
}
SERVICE_PRICE = {
    "Bridal Makeup": 8000,
    "Hair Coloring": 3000,
    "Hair Spa": 2000,
    "Facial": 1200,
    "Pedicure": 800,
    "Manicure": 700,
    "Haircut": 600,
}
DEFAULT_PRICE = 600
HIGH_RISK_PAYMENTS = ["Cash"]
WEEKEND_DAYS = ["Saturday", "Sunday"]
CHRONIC_RATE = 0.40
LONG_LEAD_DAYS = 7
EDGE_EARLY_HOUR = 9
EDGE_LATE_HOUR = 18
BAND_CAUTION = 0.25
BAND_ELEVATED = 0.40
BAND_HIGH = 0.60
BAND_CRITICAL = 0.75
RISK_HIGH = 0.60
RISK_MEDIUM = 0.40
BASELINE_NO_SHOW_PCT = 24.1
CANCEL_DRIVER_RATIO = 0.25

# Action catalog: action -> (channels, default timing days, deposit %, priority)
ACTIONS = {
    "NO_ACTION": ([], [], 0, 1),
    "SMS_REMINDER": (["SMS"], [1], 0, 2),
    "MULTI_REMINDER": (["SMS", "Email"], [1], 0, 3),
    "CALL_REMINDER": (["Call", "SMS"], [1], 0, 3),
    "SOFT_DEPOSIT": (["SMS", "Email"], [2, 1], 25, 3),
    "HARD_DEPOSIT": (["SMS", "Email", "Call"], [3, 1], 50, 4),
    "PREPAYMENT": (["Call", "SMS", "Email"], [3, 1], 100, 5),
}
DEPOSIT_ACTIONS = ["SOFT_DEPOSIT", "HARD_DEPOSIT", "PREPAYMENT"]
REMINDER_ACTIONS = ["SMS_REMINDER", "MULTI_REMINDER", "CALL_REMINDER"]

# Feature column lists (three named sets, see README)
ENGINEERED = ["Lead_Time_Days", "Appt_Hour", "Is_Edge_Hour", "Customer_No_Show_Rate", "Cancellation_Ratio",
              "Is_New_Customer", "Successful_Visit_Rate"]
EXTRA_ENGINEERED = ["Log_Past_Visit_Count", "Smoothed_NoShow_Rate", "Capped_Good_Visits",
                    "NoShow_x_LeadTime", "NewCust_x_LeadTime"]
DROP_FOR_X = ["Booking_ID", "Customer_ID", "Booking_Time", "Appointment_Time", "Booking_Lead_Time_Days",
              "Outcome", "No_Show", "Past_Visit_Count", "Past_No_Show_Count", "Past_Cancellation_Count"]
PRUNED = ["Lead_Time_Days", "Appt_Hour", "Is_Edge_Hour", "Customer_No_Show_Rate", "Is_New_Customer", "Successful_Visit_Rate", "Customer_Latent_Risk", "Past_Visit_Count",
          "Past_No_Show_Count", "Service_Type_Hair Coloring", "Payment_Method_Cash", "Payment_Method_UPI"]
